"""Lines of text files in order, and what a line inherits from lines above it, without one task for a file.

A file is read in the blocks that Spark splits it into; a line's place is its block and
its order in the block. What is carried down a file is worked out within the blocks
first, then over one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmaflow.plans.scratch import sized

PLACE = ["path", "block", "place"]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, place, line) of the text files at ``path``; lines end with a line feed, a carriage return or both."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return text.select("path", "block", F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def lines_of(texts: DataFrame) -> DataFrame:
    """The same of texts (path, value) that are at hand whole."""
    split = texts.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("place", "line"))
    return split.select("path", F.lit(0).cast("bigint").alias("block"), F.col("place").cast("bigint").alias("place"), "line")


def carried(lines: DataFrame, mark: Column, name: str) -> DataFrame:
    """``lines`` with the last ``mark`` that isn't null, of the line itself or of those above it in its file, as ``name``."""
    marked = lines.withColumn("_mark", mark)
    within = Window.partitionBy("path", "block").orderBy("place")
    ends = marked.where("_mark IS NOT NULL").groupBy("path", "block").agg(F.max_by("_mark", "place").alias("_end"))
    blocks = lines.select("path", "block").distinct().join(sized(ends), ["path", "block"], "left")
    above = blocks.select("path", "block", F.last("_end", ignorenulls=True).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    here = marked.withColumn("_here", F.last("_mark", ignorenulls=True).over(within))
    return here.join(sized(above), ["path", "block"], "left").withColumn(name, F.coalesce("_here", "_above")).drop("_mark", "_here", "_above")


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line_no``, counted from 1 in each file."""
    sizes = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("path", "block", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = lines.withColumn("_own", F.row_number().over(Window.partitionBy("path", "block").orderBy("place")))
    return own.join(sized(ahead), ["path", "block"]).withColumn("line_no", F.col("_ahead") + F.col("_own")).drop("_own", "_ahead")


def running(lines: DataFrame, **values: Column) -> DataFrame:
    """``lines`` with the sums of whole numbers over the lines above in the same file, a column for each."""
    names = list(values)
    x = lines.withColumns({f"_v_{n}": v.cast("bigint") for n, v in values.items()})
    above = lambda window, n, c: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n)
    sums = x.groupBy("path", "block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    down = Window.partitionBy("path").orderBy("block")
    ahead = sums.select("path", "block", *[above(down, f"_a_{n}", f"_s_{n}") for n in names])
    within = Window.partitionBy("path", "block").orderBy("place")
    here = x.select("*", *[above(within, f"_o_{n}", f"_v_{n}") for n in names])
    out = here.join(sized(ahead), ["path", "block"]).withColumns({n: F.col(f"_a_{n}") + F.col(f"_o_{n}") for n in names})
    return out.drop(*[f"_{k}_{n}" for k in "vao" for n in names])
