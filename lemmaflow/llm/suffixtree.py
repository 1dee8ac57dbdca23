"""LM scoring: a probabilistic suffix tree over bytes, beside an add-half unigram model over words.

Text is lower-cased words, each followed by one space, the last by the end symbol. Counts
of a byte after the five before it, gathered from every training row, give each context
of up to five bytes its next-byte distribution; a context is kept if it is frequent
enough and that distribution diverges from its parent's by more than its cost. The
longest kept suffix of what came before is the state that scores, smoothed by the shorter
ones. The tree is a table that no task and no driver holds: texts, packed, are dealt into buckets
of bounded size, every bucket asks for the prices of what occurs in it, once each, and
gets them by one join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.bytescan import LOWER, ODD, SPACE, buffers, groups_of_rows, lean, word_hashes
from lemmaflow.plans.scratch import written

DEPTH = 5
MIN_COUNT = 20
PARENT_WEIGHT = 8.0
ALPHABET = 256
BUCKET_BYTES = 1 << 25
END_WORD = np.uint64(0x2545F4914F6CDD1D)
#: The end symbol: a byte that no text in UTF-8 has.
END = 255
WORD, FOLLOWS = 0, 1


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of consecutive rows as scored, and where each row's symbols start."""
    low = LOWER[data]
    solid = ~SPACE[low]
    last = np.zeros(len(low), bool)
    if len(low):
        last[:-1] = solid[:-1] & ~solid[1:]
        last[-1] = solid[-1]
        edges = at[1:-1]
        edges = edges[(edges > 0) & (edges < len(low))]
        last[edges - 1] |= solid[edges - 1]
    sums = np.concatenate([[0], np.cumsum(solid)])
    ends = np.concatenate([[0], np.cumsum(last)])
    letters, closes = np.diff(sums[at]), np.diff(ends[at])
    starts = np.concatenate([[0], np.cumsum(letters + np.maximum(closes, 1))])
    out = np.full(starts[-1], 32, np.uint8)
    shift = starts[:-1] - sums[at[:-1]] - ends[at[:-1]]
    where = np.flatnonzero(solid)
    row = np.repeat(np.arange(len(letters)), letters)
    out[sums[where] + ends[where] + shift[row]] = low[where]
    out[starts[1:] - 1] = END
    return out, starts


def grams(out: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each symbol one number: itself in the lowest byte, and above it the ``DEPTH`` symbols before; the end symbol stands before a text."""
    n, rows = len(out), len(starts) - 1
    lead = np.full(n + rows * DEPTH, END, np.uint64)
    place = np.arange(n) + np.repeat(np.arange(1, rows + 1) * DEPTH, np.diff(starts))
    lead[place] = out
    code = lead.copy()
    for back in range(1, DEPTH + 1):
        code[back:] |= lead[:-back] << np.uint64(8 * back)
    return code[place].view(np.int64)


class Counts:
    """How often each number occurred; pieces are merged before they take much memory."""

    def __init__(self, most: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, numbers: np.ndarray, weight: np.ndarray | None = None) -> None:
        """``weight`` is 0 or 1 for each number."""
        key, n = np.unique(numbers, return_counts=True)
        if weight is not None and not weight.all():
            n = np.zeros(len(key), np.int64)
            own, k = np.unique(numbers[weight], return_counts=True)
            n[np.searchsorted(key, own)] = k
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > self.most:
            self.parts = [self.merged()]
            self.size = 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[cut], np.add.reduceat(n, cut)


PACKED = "bucket bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<bigint>, packed binary"


def dealt(bucket_bytes: int) -> Callable:
    """About a megabyte of rows as one compressed row, and its ``bucket``: neighbouring rows of one task, about ``bucket_bytes`` of text each, one packed row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for a, b in groups_of_rows(at, min(1 << 20, bucket_bytes)):
                bucket = (TaskContext.get().partitionId() << 24) + done // bucket_bytes
                done += int(at[b] - at[a])
                lists = [pa.array([x], pa.list_(x.type)) for x in (batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(np.diff(at[a : b + 1])))]
                blob = pa.compress(data[at[a] : at[b]].tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), *lists, pa.array([blob], pa.binary())], names=["bucket", "doc_ids", "held_out", "sizes", "packed"])

    return run


def unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows that packed row ``k`` holds."""
    at = np.concatenate([[0], np.cumsum(batch.column("sizes")[k].values.to_numpy())])
    data = pa.decompress(batch.column("packed")[k].as_buffer(), decompressed_size=int(at[-1]), codec="zstd") if at[-1] else b""
    return np.frombuffer(data, np.uint8), at


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, key, n): the words and grams of each bucket, and how often training rows have them, which may be never."""

    def told(bucket: int, found: tuple[Counts, Counts]) -> Iterator[pa.RecordBatch]:
        for kind, x in zip((WORD, FOLLOWS), found, strict=True):
            key, n = x.merged()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), bucket)), pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], names=["bucket", "kind", "key", "n"])

    lean()
    now, found = None, (Counts(), Counts())
    for batch in batches:
        for k, bucket in enumerate(batch.column("bucket").to_pylist()):
            if now is not None and bucket != now:
                yield from told(now, found)
                found = Counts(), Counts()
            now = bucket
            data, at = unpacked(batch, k)
            train = ~batch.column("held_out")[k].values.to_numpy(zero_copy_only=False)
            word, row = word_hashes(data, at)
            found[0].add(np.concatenate([word, np.full(len(train), END_WORD)]).view(np.int64), np.concatenate([train[row], train]))
            out, starts = symbols(data, at)
            found[1].add(grams(out, starts), np.repeat(train, np.diff(starts)))
    if now is not None:
        yield from told(now, found)


def low_bytes(key: str | Column, n: int) -> Column:
    """The lowest ``n`` bytes of a number of six."""
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseAND(F.lit((1 << 8 * n) - 1))


def context_of(key: str) -> Column:
    return F.shiftright(key, 8)


def kept_contexts(levels: list[DataFrame], min_count: int) -> list[DataFrame]:
    """For each depth (context, total) of the contexts that pass the divergence test, and of their suffixes.

    A context costs half a logarithm of its count for each byte seen after it; its count
    times its divergence from the parent must exceed that. ``levels`` has (key, n) by depth.
    """
    seen = [level.where("n > 0").withColumn("context", context_of("key")) for level in levels]
    totals = [x.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("seen")) for x in seen]
    out: list[DataFrame] = []
    wanted = None
    for depth in range(len(levels) - 1, 0, -1):
        own = seen[depth].join(totals[depth].where(F.col("total") >= min_count), "context").withColumn("above", low_bytes("key", depth))
        above = seen[depth - 1].join(totals[depth - 1].select("context", F.col("total").alias("above_total")), "context").select(F.col("key").alias("above"), F.col("n").alias("above_n"), "above_total")
        gain = F.sum(F.col("n") * F.log(F.col("n") * F.col("above_total") / (F.col("total") * F.col("above_n"))))
        test = own.join(above, "above").groupBy("context").agg(gain.alias("gain"), F.first("total").alias("total"), F.first("seen").alias("seen"))
        test = test.where(F.col("gain") > 0.5 * F.col("seen") * F.log("total")).select("context")
        if wanted is not None:
            test = test.union(wanted.select(low_bytes("context", depth).alias("context"))).distinct()
        wanted = written(test, "kept")
        out.insert(0, wanted.join(totals[depth].select("context", "total"), "context"))
    return out


def priced(follows: DataFrame, min_count: int) -> DataFrame:
    """(key, value): log10 of each gram's probability in the state of its longest kept context.

    A kept context of count c gives a byte seen n times after it (n + w p) / (c + w), p
    being what the next shorter context gives; the root's own p is uniform.
    """
    levels = [follows]
    for depth in range(DEPTH - 1, -1, -1):
        levels.insert(0, written(levels[0].groupBy(low_bytes("key", depth + 1).alias("key")).agg(F.sum("n").alias("n")), "level"))
    every = levels[0].agg(F.sum("n")).first()[0] or 0
    price = levels[0].select("key", ((F.col("n") + PARENT_WEIGHT / ALPHABET) / (every + PARENT_WEIGHT)).alias("p"))
    for depth, kept in enumerate(kept_contexts(levels, min_count), 1):
        above = price.select(F.col("key").alias("above"), F.col("p").alias("above_p"))
        own = levels[depth].withColumn("context", context_of("key")).withColumn("above", low_bytes("key", depth))
        p = F.when(F.col("total").isNotNull(), (F.col("n") + PARENT_WEIGHT * F.col("above_p")) / (F.col("total") + PARENT_WEIGHT)).otherwise(F.col("above_p"))
        price = written(own.join(above, "above").join(kept, "context", "left").select("key", p.alias("p")), "prices")
    return price.select("key", F.log10("p").alias("value"))


class Lookup:
    """Values by key, for keys that are all known: two tables by hash, and a search for the few keys that share a place in both."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.tables = []
        for odd in (ODD, np.uint64(0xD6E8FEB86659FD93)):
            bits = max(8, int(2 * len(key)).bit_length())
            shift = np.uint64(64 - bits)
            place = self.place(key, odd, shift)
            alone = np.bincount(place, minlength=1 << bits)[place] == 1
            table = np.full(1 << bits, np.nan, value.dtype)
            table[place[alone]] = value[alone]
            self.tables.append((odd, shift, table))
            key, value = key[~alone], value[~alone]
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]

    def place(self, key: np.ndarray, odd: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((key.view(np.uint64) * odd) >> shift).view(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.empty(len(key))
        rest = slice(None)
        for odd, shift, table in self.tables:
            out[rest] = table[self.place(key[rest], odd, shift)]
            rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            out[rest] = self.value[np.searchsorted(self.key, key[rest])]
        return out


def scorer(total: int, distinct: int) -> Callable:
    """Scores one bucket's rows with the prices of what occurs in it."""
    scale = math.log10(total + 0.5 * (distinct + 1))

    def run(texts: pa.Table, prices: pa.Table) -> pa.Table:
        lean()
        kind, key = prices.column("kind").to_numpy(), prices.column("key").to_numpy()
        words = kind == WORD
        counts = Lookup(key[words], prices.column("n").filter(pa.array(words)).to_numpy().astype(np.float64))
        logs = Lookup(key[~words], prices.column("value").filter(pa.array(~words)).to_numpy())
        out = []
        for batch in texts.to_batches():
            for k in range(len(batch)):
                data, at = unpacked(batch, k)
                n = len(at) - 1
                word, row = word_hashes(data, at)
                count = counts(np.concatenate([word, np.full(n, END_WORD)]).view(np.int64))
                row = np.concatenate([row, np.arange(n)])
                bytes_, starts = symbols(data, at)
                score = np.add.reduceat(logs(grams(bytes_, starts)), starts[:-1])
                columns = [np.bincount(row, minlength=n), np.bincount(row, weights=count > 0, minlength=n).astype(np.int64), np.bincount(row, weights=np.log10(count + 0.5) - scale, minlength=n), score]
                out.append(pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, batch.column("held_out")[k].values, *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out)

    return run


def score_texts(docs: DataFrame, min_count: int = MIN_COUNT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32(doc_id as text) leaves 1 modulo 5 are held out; a null id counts as
    empty text. ``base_score`` is the sum over words and one end of log10((c + 0.5) /
    (N + 0.5 (V + 1))). ``score`` is the suffix tree's log10 probability of the bytes.
    Null and empty texts hold the end alone. Repeated rows count and are scored each;
    without training rows N and V are 0 and the tree is uniform.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.pmod(crc, F.lit(5)) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(rows.mapInArrow(dealt(bucket_bytes), PACKED), "texts")
    asked = written(rows.mapInArrow(gathered, "bucket bigint, kind int, key bigint, n bigint"), "asked")
    counts = written(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind = 0").select("key", "n")
    sums = words.where("n > 0").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = sums["total"] or 0, sums["distinct"]
    price = words.select(F.lit(WORD).alias("kind"), "key", "n", F.lit(None).cast("double").alias("value"))
    price = price.union(priced(counts.where("kind = 1").select("key", "n"), min_count).select(F.lit(FOLLOWS), "key", F.lit(None).cast("bigint"), F.col("value")))
    known = asked.select("bucket", "kind", "key").join(price.hint("shuffle_hash"), ["kind", "key"]).select("bucket", "kind", "key", "n", "value")
    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = rows.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(scorer(total, distinct), kinds)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
