"""The operators of this subpackage, each applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm.auditsql import FILTER_AUDIT, SOURCE_AUDIT
from lemmaflow.llm.decontaminate import benchmark_leaks
from lemmaflow.llm.exactspans import drop_repeated_spans
from lemmaflow.llm.filteraudit import audit_filters
from lemmaflow.llm.licenses import scan_licenses
from lemmaflow.llm.mainhtml import extract_main_text
from lemmaflow.llm.mixing import mix_sources
from lemmaflow.llm.neardup import near_duplicates
from lemmaflow.llm.quality import score_quality
from lemmaflow.llm.sanitise import scan_private
from lemmaflow.llm.secrets import scan_secrets
from lemmaflow.llm.sourceaudit import audit_sources
from lemmaflow.llm.suffixtree import score_texts
from lemmaflow.llm.toxicity import score_toxicity
from lemmaflow.sources.tables import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("bigint").alias("n_detections"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_private(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("found")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_main_text": op2_main_text,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_suffix_tree": op8_suffix_tree,
        "op9_licenses": op9_licenses,
        "op10_secrets": op10_secrets,
        "op11_sanitisation": op11_sanitisation,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_interaction": op13_filter_interaction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": SOURCE_AUDIT, "op13_filter_interaction": FILTER_AUDIT}
