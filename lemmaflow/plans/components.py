"""Connected components of an undirected edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.plans.scratch import written, written_with

#: Rounds over a small table use few tasks, however many partitions the session asks for.
ROWS_PER_TASK = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b); the label is the least id of the component.

    Each round takes the least label among a node and its neighbours, then jumps to the
    label of that label, so long chains shorten fast. Rounds are written to the shared
    folder; the loop ends when no label changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, seen = written_with(both, "edges", n=F.count(F.lit(1)))
    parts = 1 + seen["n"] // ROWS_PER_TASK
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label").coalesce(parts), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = low.select(F.col("id").alias("label"), F.col("label").alias("further"))
        fresh = low.join(jump, "label").select("id", "old", F.least("label", "further").alias("label")).coalesce(parts)
        fresh, seen = written_with(fresh, "labels", moved=F.count_if(F.col("old") != F.col("label")))
        labels = fresh.select("id", "label")
        if not seen["moved"]:
            return labels
