"""Filter interaction audit: what each of five filters removes under every order in which they can run.

A document is reduced to a mask of the filters that it fails, and a part (a language) to
at most 32 counted cells of masks, so the texts are read once whatever the number of
orders. Each part then walks all 120 orders by plain changes: one swap of neighbours leads
from an order to the next, and only the two steps that trade places are counted anew from
the cells. A filter's Shapley total grows along the walk by what it removes in each order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.plans.scratch import written

FILTERS = "ABCDE"
MEASURES = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
#: Parts that are walked side by side; bounds what a task holds.
PARTS = 64
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def own_failures(text: Column, words: Column) -> Column:
    """Bits 1, 2, 4 and 8: the filters A to D, which look at one text alone. ``words`` is the text split at white space."""
    first, last = F.element_at(words, 1) == "", (F.size(words) > 1) & (F.element_at(words, -1) == "")
    n = F.size(words) - first.cast("int") - last.cast("int")
    distinct = F.size(F.array_distinct(words)) - (first | last).cast("int")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < 100, 100 * distinct.cast("bigint") < 80 * n, 100 * capitals.cast("bigint") > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail, and how many of them are labelled good or toxic.

    A text is a copy (filter E) if a row of a smaller id has the same text. Equal rows
    are counted together, and the first id of each text is found by its SHA-256, so a
    group of copies of any size is pre-aggregated before it is shuffled and joins back
    on the id and the digest, which no two groups share.
    """
    whole = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.withColumn("words", F.split("text", r"[\x20\x09-\x0D]+", -1))
    judged = whole.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("bigint")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    named = judged.where("doc_id IS NOT NULL").groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
    unnamed = judged.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = named.select("doc_id", "digest", "part", "mask", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    none = unnamed.selectExpr("cast(NULL AS bigint) AS doc_id", "cast(NULL AS binary) AS digest", "part", "mask", "n", "0L AS good", "0L AS toxic")
    rows = written(rows.union(none.select(none["doc_id"].cast(docs.schema["doc_id"].dataType).alias("doc_id"), *none.columns[1:])), "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    joined = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + copy)
    return joined.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def plain_changes(n: int) -> Iterator[int]:
    """The places k whose swaps with k + 1 lead through all orders of ``n`` things, each visited once."""
    if n < 2:
        return
    fewer = plain_changes(n - 1)
    for sweep, shift in itertools.cycle([(range(n - 2, -1, -1), 1), (range(n - 1), 0)]):
        yield from sweep
        if (k := next(fewer, None)) is None:
            return
        yield k + shift


class Walk:
    """Where the walk over the orders stands, for several parts at once.

    ``cells`` has (measure, part, mask), the measures being documents, good and toxic
    ones; ``steps`` has (filter, measure of MEASURES, part).
    """

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.masks = cells, np.arange(cells.shape[2])
        self.order = list(range(len(FILTERS)))
        self.steps = np.zeros((len(FILTERS), len(MEASURES), cells.shape[1]), np.int64)
        self.shapley = np.zeros((len(FILTERS), cells.shape[1]), np.int64)
        self.unique = np.stack([cells[0, :, 1 << f] for f in range(len(FILTERS))])
        for at in range(len(FILTERS)):
            self.count(at)

    def count(self, at: int) -> None:
        """The step at place ``at``, from the cells."""
        f, before = self.order[at], sum(1 << g for g in self.order[:at])
        there, fails = self.masks & before == 0, self.masks >> f & 1 == 1
        total = lambda k, which: self.cells[k][:, which].sum(axis=1)
        gone = there & fails
        self.steps[f] = np.stack([total(0, there & ~fails), total(0, gone), total(0, fails & ~there), total(1, gone), total(2, gone)])

    def swap(self, at: int) -> None:
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
        self.count(at)
        self.count(at + 1)

    def orders(self) -> Iterator[tuple[str, np.ndarray]]:
        """Each order and its steps in turn as (step, measure, part)."""
        for at in itertools.chain([None], plain_changes(len(FILTERS))):
            if at is not None:
                self.swap(at)
            self.shapley += self.steps[:, MEASURES.index("removed")]
            yield "".join(FILTERS[f] for f in self.order), self.steps[self.order]


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a part's cells in one row to its 600 rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, PARTS):
            some = batch.slice(start, PARTS)
            names, lists = some.column("part"), some.column("cells").to_pylist()
            cells = np.zeros((3, len(lists), 1 << len(FILTERS)), np.int64)
            for p, found in enumerate(lists):
                for c in found:
                    cells[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
            walk, size = Walk(cells), len(lists) * len(FILTERS)
            seen = list(walk.orders())
            order = np.array([[FILTERS.index(c) for c in name] for name, _ in seen])
            measured = np.stack([steps for _, steps in seen]).transpose(2, 0, 3, 1)  # (measure, order, part, step)
            by_filter = lambda x: x[order].transpose(0, 2, 1).reshape(-1)
            columns = {
                "part": names.take(pa.array(np.tile(np.repeat(np.arange(len(lists)), len(FILTERS)), len(seen)))),
                "filter_order": pa.array(np.repeat([name for name, _ in seen], size)),
                "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(lists) * len(seen))),
                **{m: pa.array(measured[k].reshape(-1)) for k, m in enumerate(MEASURES)},
                "unique_fails": pa.array(by_filter(walk.unique)),
                "shapley": pa.array(by_filter(walk.shapley)),
            }
            yield pa.RecordBatch.from_pydict({c.split()[0]: columns[c.split()[0]] for c in SCHEMA.split(", ")})


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: what the step keeps and removes, and its filter's Shapley total.

    Parts are the languages, a null one being ''. A null text is empty, and so a copy of
    any other empty text of a smaller id. Rows are documents: repeated rows count each,
    and as none has a smaller id than the other, neither is a copy of the other. A row
    without an id has no labels and is a copy of nothing. Of several labels for one id any
    that says so counts. An empty table gives no rows. Columns of other names don't matter.
    """
    cells = failure_cells(docs, labels)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(walked, SCHEMA)
