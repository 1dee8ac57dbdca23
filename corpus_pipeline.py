"""A corpus pipeline: toxic documents go, near copies go, benchmark leaks go, secrets are masked, and sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmaflow.llm.decontaminate import drop_leaks
from lemmaflow.llm.mixing import mix_sources
from lemmaflow.llm.neardup import keep_one
from lemmaflow.llm.secrets import redact
from lemmaflow.llm.toxicity import drop_toxic
from lemmaflow.plans.scratch import written
from lemmaflow.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain fitted on the table's labelled rows doesn't call toxic.

    Null and empty texts stay; without labels of both classes all do. Repeated rows are
    judged alike. An empty table stays empty; further columns are carried.
    """
    return drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the least id, and of repeated rows one.

    Rows without an id and texts without words stay. An empty table stays empty.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item; all rows of an id go if any does.

    Null and empty texts, and rows without an id, stay; an empty benchmark drops nothing.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked and ``n_chars`` counted anew; null texts stay null."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place in the mixture; a null source is one of its own, repeated rows get neighbouring places."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Signatures, latent spaces and trained models are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
