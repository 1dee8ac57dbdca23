"""Attributes of declarations: those that the dump knows, and those that the source text shows before a declaration's head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.names import attributes_of, is_companion, is_head_line, names_declaration, without_attributes

# Attributes that the dump knows.
TAG, PRIMARY = "externally_verified", "primary_spec"


def scan_headers(decl: DataFrame, code: DataFrame) -> DataFrame:
    """(id, attributes, head): what stands from a declaration's first line to the line of its head, both included.

    ``decl`` has (id, path, range_start, range_end), ``code`` the stripped lines (path,
    line_no), numbered from 1. Each line knows the next head line of its file, so a
    declaration meets its first line by equality, and then the few lines up to the head;
    no range is joined. A range that its file doesn't reach gives no row.
    """
    later = Window.partitionBy("path").orderBy(F.desc("line_no"))
    lines = code.withColumn("next_head", F.min(F.when(is_head_line(F.col("code")), F.col("line_no"))).over(later))
    begun = decl.select("id", "path", F.col("range_start").cast("bigint").alias("line_no"), F.col("range_end").cast("bigint").alias("range_end"))
    begun = begun.join(lines.select("path", "line_no", "next_head"), ["path", "line_no"])
    stop = F.least(F.coalesce("next_head", "range_end"), "range_end")
    wanted = begun.select("id", "path", F.explode(F.sequence("line_no", F.greatest(stop, "line_no"))).alias("line_no"))
    read = wanted.join(code, ["path", "line_no"]).select("id", F.struct("line_no", attributes_of(F.col("code")).alias("names"), without_attributes(F.col("code")).alias("rest")).alias("x"))
    rows = read.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("id", F.array_distinct(F.flatten(F.transform("x", lambda r: r["names"]))).alias("attributes"), F.array_join(F.transform("x", lambda r: r["rest"]), " ").alias("head"))


def declared_attributes(decl: DataFrame, scan: DataFrame) -> DataFrame:
    """(id, attributes, shows_tag, names_tag) of ``decl`` (id, name, is_instance, tagged, primary_spec_tag).

    Attributes are sorted and hold the known ones and the scanned ones. The header shows
    the tag if it stands there, and names it if the header also names the declaration.
    """
    x = decl.select("id", "name", "is_instance", "tagged", "primary_spec_tag").join(scan.withColumnRenamed("attributes", "scanned"), "id", "left")
    known = F.array_compact(F.array(F.when(F.col("tagged"), F.lit(TAG)), F.when(F.col("primary_spec_tag"), F.lit(PRIMARY))))
    scanned = F.coalesce("scanned", F.array().cast("array<string>"))
    shows = F.array_contains(scanned, TAG)
    names = shows & F.coalesce(names_declaration(F.col("head"), F.col("name"), F.coalesce("is_instance", F.lit(False))), F.lit(False))
    return x.select("id", F.array_sort(F.array_union(known, scanned)).alias("attributes"), shows.alias("shows_tag"), names.alias("names_tag"))


def tag_audit(decl: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, finding): tags that only a header names (scan-only) and tags that no header shows (tag-only)."""
    x = decl.select("id", "name", "tagged", "is_projection").join(attributes, "id")
    scan = F.col("names_tag") & ~F.col("tagged") & ~is_companion(F.col("name")) & ~F.col("is_projection")
    finding = F.when(scan, F.lit("scan-only")).when(F.col("tagged") & ~F.col("shows_tag"), F.lit("tag-only"))
    return x.select("id", finding.alias("finding")).where("finding IS NOT NULL")


def located(path: Column, source_file: DataFrame, decl: DataFrame) -> DataFrame:
    """``decl`` with ``code_path``: ``path`` where a source file of that name exists, else the empty string."""
    there = source_file.select(F.col("path").alias("code_path")).distinct().withColumn("there", F.lit(True))
    x = decl.withColumn("code_path", path).join(there, "code_path", "left")
    return x.withColumn("code_path", F.when(F.col("there"), F.col("code_path")).otherwise(F.lit(""))).drop("there")
