"""Benchmark decontamination by latent semantic retrieval.

Documents are passages of 32 words, one every 16. Hashed words weighted by inverse
document frequency make a sparse matrix; a randomised SVD over all passages and the
benchmark gives a latent space: every passage is added, with a random sign, to one of a
fixed number of rows, and that sketch of the row space is decomposed. Passages whose cosine with a benchmark passage is high
enough are candidates, and so are those in which a few words of an item begin that follow
each other as they do there: a short item's share of a passage may be too small for the
cosine. A longest common subsequence of words, with a look at the
item's closing words as its answer, decides. The benchmark is a stated query set: its
vectors go to every task, and every passage is compared with them in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.bytescan import ODD, buffers, groups_of_rows, lean, mixed, word_hashes

WIDTH = 1 << 14
RANK = 256
EXTRA = 16
STEP = 16
COSINE = 0.5
#: Words in a row that make a candidate whatever the cosine; a shorter item must occur whole.
RUN = 4
RUN_BITS = 22
SUBSEQUENCE = 0.6
ANSWER = 0.5
SURE = 0.8
SCAN_BYTES = 1 << 19
#: Words of the benchmark that one pass over the documents looks for.
BLOCK_WORDS = 1 << 17
#: Bits of a word's hash that tell which of an item's words a window holds.
HELD_BITS = 17
#: Blocks whose vectors are summed together.
NEARBY = 256
LONG_WORDS = 1 << 16
#: Parts of the sketch that one call sums.
MERGED = 256


def hashed(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(WIDTH - 1)).astype(np.int64)


def stretches(words: np.ndarray, row: np.ndarray, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Rows as they are, or one very long row in stretches that share a block: words, rows, rows' number, and words before."""
    if n_rows > 1 or len(words) <= LONG_WORDS:
        yield words, row, n_rows, 0
        return
    for k in range(0, len(words), LONG_WORDS):
        yield words[k : k + LONG_WORDS + STEP], row[k : k + LONG_WORDS + STEP], n_rows, k


def blocks_of(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of 16 words: where each begins among the words, its row, and its number within the row."""
    count = np.bincount(row, minlength=n_rows)
    per_row = -(-count // STEP)
    owner = np.repeat(np.arange(n_rows), per_row)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return first[owner] + number * STEP, owner, number


def passage_vectors(words: np.ndarray, row: np.ndarray, n_rows: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of word vectors over each block and the one after it in the row; rows and block numbers."""
    begin, owner, number = blocks_of(row, n_rows)
    size = np.diff(np.append(begin, len(words)))
    feature = hashed(words)
    block = np.zeros((len(begin), table.shape[1]), np.float32)
    room = np.empty((NEARBY, table.shape[1]), np.float32)
    for part in range(0, len(begin), NEARBY):  # few enough at once to stay in a core's cache
        own, count, sums = begin[part : part + NEARBY], size[part : part + NEARBY], block[part : part + NEARBY]
        for k in range(STEP):
            long = np.flatnonzero(count > k)
            if len(long) == len(own):
                sums += np.take(table, feature[own + k], axis=0, out=room[: len(own)], mode="clip")
            else:
                sums[long] += table[feature[own[long] + k]]
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    passage = block.copy()
    passage[follows] += block[follows + 1]
    return passage, owner, number


def sketcher(wide: int) -> Callable:
    """One task's sums of its passages' word counts: each passage goes, with a sign, to one of ``wide`` rows.

    Row and sign hang on the document's id and the passage's number, so a task that runs
    again gives the same. Row ``wide`` holds in how many documents each feature occurs,
    row ``wide`` + 1 the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros((wide + 2) * WIDTH, np.int32)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.uint64)
            total[(wide + 1) * WIDTH] += len(batch)
            for a, b in groups_of_rows(at):
                words, row = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
                feature = hashed(words)
                total[wide * WIDTH : (wide + 1) * WIDTH] += np.bincount(np.unique(row * WIDTH + feature) % WIDTH, minlength=WIDTH).astype(np.int32)
                begin, owner, number = blocks_of(row, b - a)
                h = mixed(mixed(ids[a:b][owner] + ODD) + number.astype(np.uint64) * ODD)
                cell, sign = (h % np.uint64(wide)).astype(np.int64) * WIDTH, np.where(h >> np.uint64(63), 1, -1).astype(np.int32)
                block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
                np.add.at(total, cell[block] + feature, sign[block])
                inner = number[block] > 0
                block, feature = block[inner] - 1, feature[inner]
                np.add.at(total, cell[block] + feature, sign[block])
        yield sparse_rows(total.reshape(-1, WIDTH), TaskContext.get().partitionId() // MERGED)

    return run


def sparse_rows(total: np.ndarray, share: int) -> pa.RecordBatch:
    """Rows that hold anything, as the places and values that aren't zero."""
    rows = np.flatnonzero(total.any(axis=1))
    used = [np.flatnonzero(total[k]) for k in rows]
    places = pa.array([x.astype(np.int16).tobytes() for x in used], pa.binary())
    values = pa.array([total[k, x].astype(np.int64).tobytes() for k, x in zip(rows, used, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), share, np.int64)), places, values], names=["row", "share", "places", "sums"])


def added(table: pa.Table) -> pa.Table:
    """The sum of one row over up to ``MERGED`` parts."""
    total = np.zeros((1, WIDTH), np.int64)
    for places, sums in zip(table.column("places").to_pylist(), table.column("sums").to_pylist(), strict=True):
        total[0, np.frombuffer(places, np.int16)] += np.frombuffer(sums, np.int64)
    out = pa.Table.from_batches([sparse_rows(total, table.column("share")[0].as_py() // MERGED)])
    return out.set_column(0, "row", pa.array(np.full(out.num_rows, table.column("row")[0].as_py(), np.int64)))


def corpus_sketch(texts: DataFrame, wide: int) -> np.ndarray:
    """The sketch of all passages and the document counts, ``wide`` + 2 rows. Parts are summed in two rounds, so that no task gets one of every task."""
    kinds = "row bigint, share bigint, places binary, sums binary"
    parts = texts.mapInArrow(sketcher(wide), kinds)
    for _ in range(2):
        parts = parts.groupBy("row", "share").applyInArrow(added, kinds)
    out = np.zeros((wide + 2, WIDTH), np.float32)
    for r in parts.toLocalIterator():
        out[r["row"], np.frombuffer(r["places"], np.int16)] += np.frombuffer(r["sums"], np.int64)
    return out


def item_sketch(items: list[np.ndarray], wide: int) -> np.ndarray:
    """The sketch of a block of benchmark items. Row and sign hang on a passage's first words, so blocks add up."""
    words, row = np.concatenate(items), np.repeat(np.arange(len(items)), [len(x) for x in items])
    begin, _, number = blocks_of(row, len(items))
    block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
    h = mixed(words[begin] + number.astype(np.uint64) * ODD)
    own = np.zeros((wide, WIDTH), np.float32)
    np.add.at(own, ((h % np.uint64(wide)).astype(np.int64)[block], hashed(words)), np.where(h >> np.uint64(63), 1.0, -1.0)[block].astype(np.float32))
    return own


def latent_space(sketch: np.ndarray, own: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of the leading right singular space, features by ``rank``.

    The benchmark's sketch ``own`` weighs as much as that of all documents together, so
    that the space holds its passages. Both are scaled in place. The small matrix of
    their rows' products is decomposed, so that nothing larger than the two is made.
    """
    sketch *= idf.astype(np.float32)
    own *= idf.astype(np.float32)
    own *= np.float32(max(1.0, np.linalg.norm(sketch) / max(float(np.linalg.norm(own)), 1e-9)))
    n = len(sketch)
    across = np.empty((2 * n, 2 * n))
    across[:n, :n], across[n:, n:] = sketch @ sketch.T, own @ own.T
    across[:n, n:] = sketch @ own.T
    across[n:, :n] = across[:n, n:].T
    value, vector = np.linalg.eigh(across)
    value, vector = value[::-1][:rank], vector[:, ::-1][:, :rank]
    real = value > 1e-6 * max(value[0], 1e-9)
    side = (vector[:, real] / np.sqrt(value[real])).astype(np.float32)
    return np.ascontiguousarray((side[:n].T @ sketch + side[n:].T @ own).T)


def common_subsequence(masks: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence, with the first sequence's places as bits of one number."""
    every = (1 << size) - 1
    v = every
    for mask in filter(None, map(masks.get, window)):
        u = v & mask
        v = ((v + u) | (v - u)) & every
    return size - bin(v).count("1")


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << k)
    return out


def runs(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, and where each begins."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mixed(h * ODD + words[k : k + n])
    whole = np.flatnonzero(row[:n] == row[size - 1 : size - 1 + n])
    return h[whole], whole


class Runs:
    """The benchmark's runs of ``RUN`` words, and whole items that are shorter, by hash."""

    def __init__(self, items: list[np.ndarray]):
        self.tables = []
        lengths = np.array([len(x) for x in items])
        for size in range(1, RUN + 1):
            own = np.flatnonzero(lengths == size if size < RUN else lengths >= RUN)
            if len(own):
                row = np.repeat(own, lengths[own])
                h, begin = runs(np.concatenate([items[k] for k in own]), row, size)
                pairs = np.unique(np.stack([h, row[begin].astype(np.uint64)], axis=1), axis=0)
                bits = np.zeros(1 << RUN_BITS, bool)
                bits[pairs[:, 0] >> np.uint64(64 - RUN_BITS)] = True
                self.tables.append((size, pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), bits))

    def met(self, words: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and items: an item's run begins in the first block of the passage. ``first`` has each row's first passage."""
        passages, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        start = np.searchsorted(row, np.arange(len(first)))
        for size, known, item, bits in self.tables:
            h, begin = runs(words, row, size)
            maybe = bits[h >> np.uint64(64 - RUN_BITS)]
            h, begin = h[maybe], begin[maybe]
            low, high = np.searchsorted(known, h), np.searchsorted(known, h, "right")
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(begin, n)
            passages.append(first[row[begin]] + (begin - start[row[begin]]) // STEP)
            items.append(item[which])
        return np.concatenate(passages), np.concatenate(items)


def held_place(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - HELD_BITS)).astype(np.int64)


class Queries:
    """A block of benchmark items, ready to be searched for: their vectors, runs of words, and tests for order and answer."""

    def __init__(self, items: list[np.ndarray], table: np.ndarray):
        self.lengths = np.array([len(x) for x in items])
        row_of = np.repeat(np.arange(len(items)), self.lengths)
        words = np.concatenate(items)
        vectors, self.owner, _ = passage_vectors(words, row_of, len(items), table)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.own = np.searchsorted(self.owner, np.arange(len(items) + 1))
        self.verbatim = Runs(items)
        whole = [x.tolist() for x in items]
        tails = [x[-max(3, len(x) // 4) :] for x in whole]
        self.tests = [(masks_of(x), masks_of(t), len(t)) for x, t in zip(whole, tails, strict=True)]
        feature = held_place(words)
        self.held = np.zeros((len(items), 1 << HELD_BITS >> 3), np.uint8)
        np.bitwise_or.at(self.held, (row_of, feature >> 3), np.uint8(1) << (feature & 7).astype(np.uint8))

    def candidates(self, passages: np.ndarray, words: np.ndarray, row: np.ndarray, first: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and cosines of pairs that are near enough or share a run, each once."""
        p, item, near = [], [], []
        for part in range(0, len(passages), 4096):
            close = passages[part : part + 4096] @ self.vectors.T
            hits = np.flatnonzero(close >= cosine)
            p.append(hits // len(self.owner) + part)
            item.append(self.owner[hits % len(self.owner)])
            near.append(close.ravel()[hits])
        at, which = self.verbatim.met(words, row, first)
        p, item = np.concatenate([*p, at]), np.concatenate([*item, which])
        near = np.concatenate([*near, np.full(len(at), -2.0, np.float32)])
        if not len(p):
            return p, item, near
        order = np.lexsort((item, p))
        p, item, near = p[order], item[order], near[order]
        cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (item[1:] != item[:-1])]))
        return p[cut], item[cut], np.maximum.reduceat(near, cut)

    def enough(self, feature: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether a window holds as many words of the item's as a subsequence would need; equal hashed words count as equal."""
        out = np.zeros(len(item), bool)
        ends = np.cumsum(stop - begin)
        k = 0
        while k < len(item):
            m = max(k + 1, int(np.searchsorted(ends, ends[k] + (1 << 20))))
            size = (stop - begin)[k:m]
            at = np.repeat(begin[k:m] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            f = feature[at]
            held = (self.held[np.repeat(item[k:m], size), f >> 3] >> (f & 7).astype(np.uint8)) & 1
            out[k:m] = np.add.reduceat(held, np.cumsum(size) - size, dtype=np.int64) / self.lengths[item[k:m]] >= SUBSEQUENCE
            k = m
        return out


def searcher(ids: list[int | None], items: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, cosine: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = basis * idf[:, None].astype(np.float32)
        queries = Queries(items, table)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            found: dict[tuple[int, int], list] = {}
            for a, b in groups_of_rows(at, SCAN_BYTES):
                words, row = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
                if not len(words):
                    continue
                feature = held_place(words)
                first = np.searchsorted(row, np.arange(b - a + 1))
                for some, some_rows, n_rows, before in stretches(words, row, b - a):
                    passages, place, number = passage_vectors(some, some_rows, n_rows, table)
                    passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-9)
                    p, item, near = queries.candidates(passages, some, some_rows, np.searchsorted(place, np.arange(n_rows)), cosine)
                    doc, n = place[p], queries.lengths[item]
                    middle = first[doc] + before + number[p] * STEP
                    begin, stop = np.maximum(first[doc], middle - n), np.minimum(first[doc + 1], middle + 2 * STEP + n)
                    for k in np.flatnonzero(queries.enough(feature, item, begin, stop)).tolist():
                        whole, tail, answer_words = queries.tests[item[k]]
                        window = words[begin[k] : stop[k]].tolist()
                        lcs = common_subsequence(whole, int(n[k]), window) / int(n[k])
                        if lcs < SUBSEQUENCE:
                            continue
                        answer = common_subsequence(tail, answer_words, window) / answer_words
                        if lcs >= SURE or answer >= ANSWER:
                            close = near[k] if near[k] > -2 else (queries.vectors[queries.own[item[k]] : queries.own[item[k] + 1]] @ passages[p[k]]).max()
                            best = found.setdefault((a + int(doc[k]), int(item[k])), [-1.0, 0.0, 0.0])
                            best[:] = map(max, best, (float(close), lcs, answer))
            keys = sorted(found)
            doc_ids = batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64()))
            values = [found[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array([ids[k[1]] for k in keys], pa.int64()), *(pa.array([v[c] for v in values], pa.float64()) for c in range(3))], names=["doc_id", "item_id", "cosine", "subsequence", "answer"]
            )

    return run


def blocks_of_items(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and words of the items that have words, in blocks of about ``block_words`` words, one item at least."""
    ids: list[int | None] = []
    items: list[np.ndarray] = []
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        data, at = buffers(pa.array([r["text"]], pa.large_string()))
        words = word_hashes(data[: at[-1]], at)[0]
        if not len(words):
            continue
        ids.append(r["item_id"])
        items.append(words)
        if sum(map(len, items)) >= block_words:
            yield ids, items
            ids, items = [], []
    if items:
        yield ids, items


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and benchmark item that it repeats: doc_id, item_id, cosine, subsequence, answer.

    ``subsequence`` is the share of the item's words, in order, found near the passage;
    ``answer`` the same for its last quarter. A pair stands from 0.8 on, or from 0.6 with
    half the answer. Words are lower-cased A to Z. Null and empty texts, items included,
    match nothing; an empty benchmark gives no rows. Repeated documents give their rows
    again; items that repeat an id are each compared. A benchmark of more than
    ``block_words`` words is searched for in blocks, each in a pass over the documents, so
    that no task holds more than one block.
    """
    kinds = "doc_id bigint, item_id bigint, cosine double, subsequence double, answer double"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wide = rank + EXTRA
    own, blocks = np.zeros((wide, WIDTH), np.float32), 0
    for _, items in blocks_of_items(benchmark, block_words):
        own += item_sketch(items, wide)
        blocks += 1
    if not blocks:
        return docs.sparkSession.createDataFrame([], kinds)
    sketch = corpus_sketch(texts, wide)
    idf = np.log((sketch[-1, 0] + 1) / (sketch[-2] + 1)).astype(np.float64) + 1e-3
    basis = latent_space(sketch[:-2], own, idf, rank)
    del sketch, own
    out = [texts.mapInArrow(searcher(ids, items, idf, basis, cosine), kinds) for ids, items in blocks_of_items(benchmark, block_words)]
    return functools.reduce(DataFrame.union, out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that repeat a benchmark item; rows without an id stay."""
    leaks = benchmark_leaks(docs, benchmark).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
