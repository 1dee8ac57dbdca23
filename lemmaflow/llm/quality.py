"""Quality rules: how much more a text looks like a trusted target than like the raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials
over the buckets, one of the trusted rows and one of every row, give each bucket a
log-likelihood ratio; a text's score is the mean over its n-grams, and a fixed
threshold decides. Everything here is DataFrame work: no Python runs on executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.columns import packed, without

BUCKETS = 1 << 15
TARGET_ROWS = 20_000
SMOOTHING = 1.0
THRESHOLD = -0.05
MIN_WORDS = 50
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.array_remove(F.split(text, SPACES), "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(h: Column, buckets: int) -> Column:
    """Buckets of every word and of every pair of neighbouring words, from the words' hashes."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)))
    two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(buckets)))
    return F.concat(one, two)


def repeated_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds ``out``: how many words lie in a three-word window that occurs twice or more in the row.

    ``hashes`` holds the words' 64-bit hashes, and windows are compared by a hash of
    three; only rows with an equal pair sort their windows.
    """
    later = F.slice(hashes, 3, F.greatest(F.size(hashes) - 2, F.lit(0)))
    df = df.withColumn("_h", F.transform(later, lambda x, i: F.xxhash64(F.get(F.col(hashes), i), F.get(F.col(hashes), i + 1), x)))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.get(F.col("_s"), k - 1)["h"] == x["h"]) | (F.get(F.col("_s"), k + 1)["h"] == x["h"])
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull() & (F.size("_s") > 0), F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["i"]))))
    steps = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(3))).cast("bigint"))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.size("_p") > 0, covered).otherwise(F.lit(0).cast("bigint"))).drop("_h", "_s", "_p")


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the words' hashes ``_x`` and the plain counts that judge a text on its own."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_t", t).withColumn("_w", words(F.col("_t"))).withColumn("_l", lines).withColumn("_x", word_hashes(F.col("_w")))
    df = repeated_words(df, "_x", "n_repeat_words")
    n = F.size("_w").cast("bigint")
    return df.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n),
    }).drop("_l", "_t", "_w")


def trusted_rows(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` distinct ids labelled good, those with the lowest hash."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def gram_counts(docs: DataFrame, labels: DataFrame, buckets: int, target_rows: int) -> DataFrame:
    """Per bucket: n-grams in all rows and in the trusted rows. The trusted ids are few by ``target_rows``, so they are broadcast."""
    trusted = F.broadcast(trusted_rows(labels, target_rows).withColumn("_target", F.lit(True)))
    rows = docs.select("doc_id", "text").join(trusted, "doc_id", "left")
    rows = rows.select("_target", word_hashes(words(F.coalesce("text", F.lit("")))).alias("_x"))
    rows = rows.select("_target", F.explode(grams(F.col("_x"), buckets)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n_raw"), F.count("_target").alias("n_target"))


def log_ratios(counts: DataFrame, buckets: int, smoothing: float) -> list[float]:
    """The fitted model: one number a bucket, so its size is fixed by ``buckets``."""
    found = {r["bucket"]: (r["n_raw"], r["n_target"]) for r in counts.collect()}
    raw, target = (sum(x[k] for x in found.values()) for k in (0, 1))
    if not target:
        return [0.0] * buckets
    out = []
    for b in range(buckets):
        r, t = found.get(b, (0, 0))
        out.append(round(math.log((t + smoothing) / (target + smoothing * buckets)) - math.log((r + smoothing) / (raw + smoothing * buckets)), 6))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``llr`` (mean log-likelihood ratio over the n-grams) and ``kept``.

    A row is kept if the base rules pass and ``llr >= threshold``. Null or empty text has
    no words: ``llr`` 0, not kept. Without a trusted row every ``llr`` is 0. Repeated rows
    are judged alike and counted each; a null ``doc_id`` is scored but never trusted.
    Columns of ``docs`` stay, apart from those that carry the names added here.
    """
    ratios = log_ratios(gram_counts(docs, labels, buckets, target_rows), buckets, smoothing)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    df = base_rules(docs.select(packed(without(docs, ADDED)), "text")).withColumn("_g", grams(F.col("_x"), buckets))
    total = F.aggregate("_g", F.lit(0.0), lambda a, g: a + F.get(table, g))
    df = df.withColumn("llr", F.when(F.size("_g") > 0, F.round(total / F.size("_g"), 9)).otherwise(F.lit(0.0)))
    return df.select("row.*", *ADDED[:-1], (~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).alias("kept"))
