"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories' probabilities.

Earlier probabilities used in training are out-of-fold, so that a later model learns how
far to trust them. Features are the distinct words of a text and four-letter word
beginnings, those that tell the labels apart best. The models are fitted in one task on a
bounded sample of labelled rows, and only their weights come to the driver; every document
is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lemmaflow.llm.bytescan import lean
from lemmaflow.llm.columns import packed
from lemmaflow.plans.scratch import written

SAMPLE_ROWS = 12_000
FEATURES = 2_048
FOLDS = 3
THRESHOLD = 0.15
ROUNDS = 150
L2 = 1e-3

# Words that tell the categories of a text labelled toxic.
CATEGORIES = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser", "fool", "dumb"],
    "contempt": ["scum", "trash", "worthless", "pathetic", "disgusting", "garbage", "vermin"],
}
CHAIN = [*CATEGORIES, "toxic"]


def features(text: Column) -> Column:
    """Distinct lower-case words, and the beginnings of those of six letters or more, marked by a tilde."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), ""))
    long = F.filter(words, lambda w: F.length(w) >= 6)
    return F.concat(words, F.array_distinct(F.transform(long, lambda w: F.concat(F.substring(w, 1, 4), F.lit("~")))))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Features and labels of at most ``rows`` labelled ids, those with the lowest hash; that bound lets them be broadcast. An id with several texts counts by the least."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    return found.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), features(F.col("text")).alias("features"))


def telling(rows: DataFrame, most: int) -> tuple[list[str], list[float]]:
    """The features that tell toxic rows from others best by log-likelihood ratio, and their log odds."""
    n, bad = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return [], []
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("k"))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    a, b = F.col("a"), F.col("k") - F.col("a")
    counts = counts.withColumn("g", part(a, F.col("k") * bad / n) + part(b, F.col("k") * (n - bad) / n) + part(bad - a, (n - F.col("k")) * bad / n) + part(n - bad - b, (n - F.col("k")) * (n - bad) / n))
    best = counts.where("k >= 3").orderBy(F.desc("g"), "feature").limit(most).collect()
    odds = [float(np.log((r["a"] + 0.5) / (bad + 1)) - np.log((r["k"] - r["a"] + 0.5) / (n - bad + 1))) for r in best]
    return [r["feature"] for r in best], odds


class Linear:
    """A logistic model over sparse rows, fitted by accelerated descent with a step for each weight that its curvature bounds."""

    def __init__(self, width: int):
        self.w, self.b = np.zeros(width), 0.0

    @classmethod
    def of(cls, w: list[float], extra: list[float], b: float) -> Linear:
        model = cls(len(w))
        model.w, model.extra, model.b = np.array(w, float), np.array(extra, float), b
        return model

    def fit(self, x: Sparse, extra: np.ndarray, y: np.ndarray) -> Linear:
        n, k = len(y), extra.shape[1]
        mass = np.bincount(x.row, weights=np.abs(x.value), minlength=n) + extra.sum(axis=1) + 1.0
        own = np.bincount(x.column, weights=np.abs(x.value) * mass[x.row], minlength=x.width)
        rate = 1.0 / (0.25 * np.concatenate([own, extra.T @ mass, [mass.sum()]]) / max(n, 1) + L2)
        w, prior = np.zeros(len(self.w) + k + 1), np.zeros(len(self.w) + k + 1)
        for t in range(ROUNDS):
            v = w + t / (t + 3) * (w - prior)
            p = sigmoid(x.dot(v[: len(self.w)]) + extra @ v[len(self.w) : -1] + v[-1])
            r = p - y
            g = np.concatenate([x.back(r), extra.T @ r, [r.sum()]]) / n + L2 * np.append(v[:-1], 0.0)
            prior, w = w, v - rate * g
        self.w, self.extra, self.b = w[: len(self.w)], w[len(self.w) : -1], float(w[-1])
        return self

    def predict(self, x: Sparse, extra: np.ndarray) -> np.ndarray:
        return sigmoid(x.dot(self.w) + extra @ self.extra + self.b)


class Sparse:
    """Rows of (feature, value)."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, width: int):
        self.row, self.column, self.value, self.n, self.width = row, column, value, n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column] * self.value, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=r[self.row] * self.value, minlength=self.width)

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        use = place[self.row] >= 0
        return Sparse(place[self.row[use]], self.column[use], self.value[use], len(rows), self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def sparse(lists: pa.ListArray, names: pa.Array, odds: np.ndarray) -> Sparse:
    """Present features, valued by their log odds."""
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    place = pc.index_in(lists.flatten(), value_set=names)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    column = place.fill_null(0).to_numpy().astype(np.int64)[known]
    return Sparse(row[known], column, odds[column] if len(column) else np.zeros(0), len(lists), len(names))


def listed(column: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    """One array of lists that starts at 0, nulls as empty lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays([column.take(pa.array(np.arange(len(column))))])


def fit_chain(x: Sparse, truth: dict[str, np.ndarray], folds: np.ndarray) -> list[Linear]:
    """One model a category, in order; what a later one sees of the earlier is predicted by models that left the row's fold out."""
    models, seen = [], np.zeros((x.n, 0))
    for name in CHAIN:
        y = truth[name].astype(float)
        models.append(Linear(x.width).fit(x, seen, y))
        out = np.zeros(x.n)
        for k in range(FOLDS):
            rest, own = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
            if len(own) and len(rest):
                out[own] = Linear(x.width).fit(x.take(rest), seen[rest], y[rest]).predict(x.take(own), seen[own])
        seen = np.column_stack([seen, out])
    return models


MODEL = "place int, w array<double>, extra array<double>, b double"


def trainer(names: list[str], odds: list[float]) -> Callable[[pa.Table], pa.Table]:
    """Fits the chain on a table of training rows; its weights, a row for each model."""

    def run(train: pa.Table) -> pa.Table:
        lean()
        train = train.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
        lists = listed(train.column("f"))
        x = sparse(lists, pa.array(names, pa.string()), np.array(odds))
        toxic = train.column("toxic").to_numpy() > 0
        row, words = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), lists.flatten()
        has = lambda ws: np.bincount(row[pc.is_in(words, value_set=pa.array(ws, pa.string())).to_numpy(zero_copy_only=False)], minlength=len(lists)) > 0
        truth = {c: toxic & has(ws) for c, ws in CATEGORIES.items()} | {"toxic": toxic}
        models = fit_chain(x, truth, train.column("fold").to_numpy())
        return pa.table({
            "place": pa.array(range(len(models)), pa.int32()),
            "w": pa.array([m.w for m in models], pa.list_(pa.float64())),
            "extra": pa.array([m.extra for m in models], pa.list_(pa.float64())),
            "b": pa.array([m.b for m in models], pa.float64()),
        })

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, width: int = FEATURES) -> tuple[list[str], np.ndarray, list[Linear]]:
    """The chosen features, their log odds and the chain. Without both classes in the sample there is no feature and no model."""
    rows = written(sample(docs, labels, sample_rows), "labelled")
    names, odds = telling(rows, width)
    if not names:
        return [], np.zeros(0), []
    lexicon = [w for ws in CATEGORIES.values() for w in ws]
    held = F.array(*[F.lit(w) for w in dict.fromkeys([*names, *lexicon])])
    train = rows.select("doc_id", "toxic", "fold", F.array_intersect("features", held).alias("f"))
    models = [Linear.of(r["w"], r["extra"], r["b"]) for r in train.groupBy().applyInArrow(trainer(names, odds), MODEL).orderBy("place").collect()]
    return names, np.array(odds), models


def scorer(names: list[str], odds: np.ndarray, models: list[Linear]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        known = pa.array(names, pa.string())
        for batch in batches:
            x = sparse(listed(batch.column("f")), known, odds)
            seen = np.zeros((x.n, 0))
            for model in models:
                seen = np.column_stack([seen, model.predict(x, seen)])
            if not models:
                seen = np.zeros((x.n, len(CHAIN)))
            seen[np.bincount(x.row, minlength=x.n) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(seen[:, k]) for k in range(len(CHAIN)))], names=["row", *(f"p_{c}" for c in CHAIN)])

    return run


def scored(rows: DataFrame, names: list[str], training: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, a probability for each category): the ``names`` of ``rows`` packed, scored by a chain fitted on ``training``."""
    known, odds, models = fit(training, labels)
    held = F.array(*[F.lit(f) for f in known]) if known else F.array().cast("array<string>")
    asked = rows.select(packed(names), F.array_intersect(features(F.col("text")), held).alias("f"))
    kinds = StructType([asked.schema["row"], *(StructField(f"p_{c}", DoubleType()) for c in CHAIN)])
    return asked.mapInArrow(scorer(known, odds, models), kinds)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every row (doc_id unless told otherwise), a probability for each category, and ``toxic``.

    Texts without a telling feature, null and empty ones among them, have probability 0
    throughout: nothing speaks against them. Without labels of both classes all have. A label row that
    repeats an id counts once, toxic if any says so; repeated documents are scored alike.
    Of ``carry``, columns with the names added here are left out.
    """
    taken = {f"p_{c}" for c in CHAIN} | {"toxic"}
    names = [c for c in (carry or ["doc_id"]) if c.lower() not in taken]
    return scored(docs, names, docs, labels).select("row.*", *[f"p_{c}" for c in CHAIN], (F.col("p_toxic") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows called toxic, by models fitted on ``labelled_docs``; columns stay as they are, whatever their names."""
    return scored(docs, docs.columns, labelled_docs, labels).where(F.col("p_toxic") < threshold).select("row.*")
