"""Cutting lineage: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Where a session on one machine keeps its tables if its settings name no folder.
_ONE_MACHINE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting a cluster has no place that all executors see, which is an
    error. A session whose driver and executors are one process (``local[...]``) can do
    with a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _ONE_MACHINE:
        _ONE_MACHINE.append(tempfile.mkdtemp(prefix="lemmaflow-"))
    return _ONE_MACHINE[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike a local checkpoint, the copy survives the loss of executors. The folder's
    owner expires old tables; each call gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lemmaflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates over the rows that are taken while they are written, without a job of their own; 0 where nothing was written."""
    seen = Observation()
    out = written(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
    return out, defaultdict(int, seen.get)


def sized(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is met by a shuffle and never sent whole through the driver.

    Spark judges a side by its compressed columns, of which millions of rows fit under
    the size that it broadcasts.
    """
    return df.hint("merge")


class Buckets:
    """Tables in the shared folder that are bucketed by the column ``id``, and so joined on it without a shuffle.

    Buckets belong to a table's entry in the session's catalog. The entries go when the
    block ends; the files stay, for whoever reads them by path.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.names: list[str] = []

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *error: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, what: str) -> tuple[str, str]:
        """A name for a table and the folder of its files."""
        self.names.append(name := f"lemmaflow_{what}_{uuid.uuid4().hex}")
        return name, f"{shared_folder(self.spark)}/lemmaflow/{name}"

    def add(self, df: DataFrame, table: tuple[str, str], **measures: Column) -> dict:
        """Appends ``df``, whose rows lie by bucket, and gives aggregates over its rows."""
        seen = Observation()
        df = df.observe(seen, *[m.alias(k) for k, m in measures.items()]) if measures else df
        df.write.mode("append").format("parquet").option("compression", "zstd").option("path", table[1]).bucketBy(self.buckets, "id").saveAsTable(table[0])
        return defaultdict(int, seen.get) if measures else {}
