"""Suffix-array dedup: removal of every byte covered by a 100-byte string that starts earlier.

Sorting all suffixes of a corpus in one place can't scale, so windows are first dealt to
where their equals must be. The least-hash 24-gram of a 100-byte window is its anchor:
equal windows have equal anchors at equal offsets, and one anchor stands for a run of
up to 77 window starts. Anchors seen once hold no repeat. A run that repeats whole is a
repeat throughout. What is left, the runs whose surroundings differ, goes to shards by
anchor: each shard sorts its suffixes by Larsson-Sadakane refinement, Kasai's lengths
tell which neighbours share 100 bytes, and anchors too frequent for one shard are
spread over several, whose sorted firsts are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.bytescan import ODD, buffers, lean, mixed, prefix_hashes
from lemmaflow.plans.scratch import written

WINDOW = 100
GRAM = 24
SPAN = WINDOW - GRAM + 1
LOW = np.uint64((1 << 26) - 1)
SCAN_BYTES = 1 << 17
LONG_PIECE = 1 << 24
SHARD_RECORDS = 16_000
HOT_RECORDS = 4_000
#: Runs at one anchor that a task sorts, and busier anchors, the busiest first, that are cut into parts.
BUSY_RUNS, MOST_BUSY = 100_000, 10_000


def pieces(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, starts and stops of texts to scan together; a very long text comes in overlapping pieces that share no window."""
    rows, starts, stops, size = [], [], [], 0
    for k in range(len(at) - 1):
        a, b = int(at[k]), int(at[k + 1])
        for start in range(a, max(b - WINDOW + 1, a), LONG_PIECE):
            stop = min(b, start + LONG_PIECE + WINDOW - 1)
            if rows and size + stop - start > SCAN_BYTES:
                yield np.array(rows), np.array(starts), np.array(stops)
                rows, starts, stops, size = [], [], [], 0
            rows.append(k)
            starts.append(start)
            stops.append(stop)
            size += stop - start
    if rows:
        yield np.array(rows), np.array(starts), np.array(stops)


def anchors_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: each anchor's hash and place, its first and last window start, and a hash of what the run covers."""
    sums, down = prefix_hashes(data)
    n = len(data)
    gram = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])
    low = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    windows = n - WINDOW + 1
    low = np.minimum(low[:windows], low[SPAN - width : SPAN - width + windows])
    anchor = (low & LOW).astype(np.int64)
    for end in ends[:-1]:
        anchor[max(0, end - WINDOW + 1) : min(end, windows)] = -1
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], windows) - 1
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    place = anchor[first]
    shape = ((place - first) * 128 + (last - first)).astype(np.uint64)
    record = mixed((sums[last + WINDOW] - sums[first]) * down[first] + mixed(shape + ODD))
    return gram[place], place, first, last, record


def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, rec, doc, place): place packs the anchor's byte offset, its distance from the first start and the run's length."""
    lean()
    for batch in batches:
        data, at = buffers(batch.column("text"))
        doc = batch.column("doc").to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for rows, starts, stops in pieces(at):
            sizes = stops - starts
            if sizes.max() < WINDOW:
                continue
            text = data[starts[0] : stops[0]] if len(rows) == 1 else np.concatenate([data[a:b] for a, b in zip(starts, stops, strict=True)])
            ends = np.cumsum(sizes)
            gram, place, first, last, record = anchors_of(text, ends)
            piece = np.searchsorted(ends, place, side="right")
            offset = place - (ends - sizes)[piece] + starts[piece] - at[rows[piece]]
            out.append((gram.view(np.int64), record.view(np.int64), doc[rows[piece]], (offset << 14) | ((place - first) << 7) | (last - first)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["fp", "rec", "doc", "place"])


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that a run of windows covers, for the runs asked for."""
    lean()
    for batch in batches:
        data, at = buffers(batch.column("text"))
        wanted = batch.column("runs")
        counts = np.diff(np.asarray(wanted.offsets))
        runs = wanted.flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        place = runs.field("place").to_numpy()
        start = at[row] + (place >> 14) - ((place >> 7) & 127)
        stop = start + (place & 127) + WINDOW
        ok = (start >= at[row]) & (stop <= at[row + 1])
        text = pa.array([data[a:b].tobytes() for a, b in zip(start[ok], stop[ok], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(runs.field("fp").to_numpy()[ok]), pa.array(batch.column("doc").to_numpy()[row[ok]]), pa.array((start - at[row])[ok]), text], names=["fp", "doc", "start", "bytes"])


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each suffix's place in it. The order must be total, or Kasai's step doesn't hold.

    Larsson and Sadakane's refinement: groups with equal prefixes of length h are sorted
    by the groups of the suffixes h further on; suffixes alone in their group are done.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.empty(n + 1, np.int64)
    group[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    group[n] = 0
    h = 7
    while True:
        alone = head & np.append(head[1:], True)
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            break
        suffix = order[open_places]
        pair = (group[suffix] << 32) | group[np.minimum(suffix + h, n)]
        within = np.argsort(pair, kind="stable")
        order[open_places] = suffix[within]
        pair = pair[within]
        head[open_places] = np.concatenate([[True], pair[1:] != pair[:-1]])
        group[order[open_places]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[open_places] + 1
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, at most ``most``.

    Kasai's step, from a suffix to the next one in the text, loses one byte at most; it
    runs for all records side by side.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int16), np.full(most, -1, np.int16)])
    shared = np.zeros(n, np.int64)
    now = np.zeros(len(firsts), np.int64)
    for k in range(int(sizes.max())):
        lane = np.flatnonzero(sizes > k)
        here = firsts[lane] + k
        at = place[here]
        other = order[np.maximum(at - 1, 0)]
        h = np.where(at > 0, np.maximum(now[lane] - 1, 0), most)
        live = np.flatnonzero(h < most)
        while len(live):
            same = padded[here[live] + h[live]] == padded[other[live] + h[live]]
            live = live[same]
            h[live] += 1
            live = live[h[live] < most]
        h[at == 0] = 0
        now[lane] = h
        shared[here] = h
    return shared


def shard_repeats(table: pa.Table) -> pa.Table:
    """Of one shard's records: runs of starts that repeat an earlier window (hot false), and, for spread anchors, each distinct window's first start (hot true)."""
    lean()
    data, at = buffers(table.column("bytes").combine_chunks())
    text = data[at[0] : at[-1]]
    firsts, sizes = at[:-1] - at[0], np.diff(at)
    order, place = suffix_array(text)
    shared = common_prefixes(text, order, place, firsts, sizes, WINDOW)
    doc, start, hot = table.column("doc").to_numpy(), table.column("start").to_numpy(), table.column("hot").to_numpy()
    record = np.repeat(np.arange(len(firsts)), sizes)
    offset = np.arange(len(text)) - firsts[record]
    window = offset + WINDOW <= sizes[record]
    begins = np.concatenate([[True], shared[order][1:] < WINDOW])
    label = np.cumsum(begins) - 1
    valid = window[order]
    suffix, label = order[valid], label[valid]
    by_age = np.lexsort((start[record[suffix]] + offset[suffix], doc[record[suffix]]))
    age = np.empty(len(suffix), np.int64)
    age[by_age] = np.arange(len(suffix))
    oldest = np.full(int(label.max()) + 1 if len(label) else 0, len(suffix))
    np.minimum.at(oldest, label, age)
    repeat = np.sort(suffix[age != oldest[label]])
    cut = np.flatnonzero(np.concatenate([[True], (repeat[1:] != repeat[:-1] + 1) | (record[repeat[1:]] != record[repeat[:-1]])])) if len(repeat) else np.zeros(0, np.int64)
    a, b = repeat[cut], repeat[np.append(cut[1:], len(repeat)) - 1] if len(repeat) else repeat
    keep = suffix[(age == oldest[label]) & hot[record[suffix]]]
    sums, down = prefix_hashes(text)
    one = mixed((sums[keep + WINDOW] - sums[keep]) * down[keep]).view(np.int64)
    two = np.array([int.from_bytes(hashlib.blake2b(text[k : k + WINDOW].tobytes(), digest_size=8).digest(), "big", signed=True) for k in keep], np.int64)
    rows = np.concatenate([record[a], record[keep]])
    return pa.table({
        "hot": np.concatenate([np.zeros(len(a), bool), np.ones(len(keep), bool)]),
        "doc": doc[rows],
        "start": np.concatenate([start[record[a]] + offset[a], start[record[keep]] + offset[keep]]),
        "stop": np.concatenate([start[record[b]] + offset[b], start[record[keep]] + offset[keep]]) + WINDOW,
        "one": np.concatenate([np.zeros(len(a), np.int64), one]),
        "two": np.concatenate([np.zeros(len(a), np.int64), two]),
        "shard": np.full(len(rows), table.column("shard")[0].as_py(), np.int64),
    })


def merged_runs(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Rows of two runs in order of their hashes as one, of equal windows the oldest; the others are marked ``late``. The second run is searched in the first."""
    one, two = x["one"], x["two"]
    at = np.searchsorted(one[a], one[b])
    while True:
        behind = at < len(a)
        old, new = a[at[behind]], b[behind]
        behind[behind] = (one[old] == one[new]) & (two[old] < two[new])
        if not behind.any():
            break
        at += behind
    met = at < len(a)
    met[met] = (one[a[at[met]]] == one[b[met]]) & (two[a[at[met]]] == two[b[met]])
    old, new = a[at[met]], b[met]
    newer = (x["doc"][new] > x["doc"][old]) | ((x["doc"][new] == x["doc"][old]) & (x["start"][new] > x["start"][old]))
    same = (x["doc"][new] == x["doc"][old]) & (x["start"][new] == x["start"][old])
    late[new[newer]] = True
    late[old[~newer & ~same]] = True
    a = a.copy()
    a[at[met][~newer]] = new[~newer]
    return np.insert(a, at[~met], b[~met])


def merged_repeats(table: pa.Table) -> pa.Table:
    """Of spread anchors' windows in one range of hashes, those that another shard has from earlier. Sorted runs are merged in pairs, so a row is met once a doubling, however many shards there are."""
    x = {k: table.column(k).to_numpy() for k in ("one", "two", "doc", "start", "shard")}
    late = np.zeros(len(x["one"]), bool)
    order = np.lexsort((x["two"], x["one"], x["shard"]))
    runs = np.split(order, np.flatnonzero(np.diff(x["shard"][order])) + 1)
    while len(runs) > 1:
        runs = [merged_runs(x, *pair, late) if len(pair := runs[k : k + 2]) == 2 else pair[0] for k in range(0, len(runs), 2)]
    return pa.table({"doc": x["doc"][late], "start": x["start"][late], "stop": x["start"][late] + WINDOW})


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of every text once its spans are gone."""
    lean()
    for batch in batches:
        data, at = buffers(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        n_removed, n_spans, digests = [], [], []
        for k, own in enumerate(spans):
            text = data[at[k] : at[k + 1]]
            if own:
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, [x["start"] for x in own], 1)
                np.add.at(step, [x["stop"] for x in own], -1)
                gone = np.cumsum(step)[:-1] > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                text = text[~gone]
            else:
                n_removed.append(0)
                n_spans.append(0)
            digests.append(hashlib.sha256(text.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_anchors(seen: DataFrame, busy: int) -> DataFrame:
    """(fp, doc, place, whole): the runs at anchors that occur again, and whether an earlier run of the same bytes makes the whole run a repeat; first runs stay only where other runs at the anchor differ.

    Runs at one anchor are told apart by a window. Anchors of over ``busy`` runs, the
    ``MOST_BUSY`` busiest, are cut into parts for it, so that no task sorts one alone. A
    run that isn't the first of its bytes in its part is a repeat whatever other parts
    hold; the parts' firsts alone, which are few where runs are alike, are compared again.
    """
    counts = written(seen.groupBy("fp").agg(F.count("*").alias("runs")).where(F.col("runs") > busy), "busy-anchors")
    hot = [r["fp"] for r in counts.orderBy(F.desc("runs"), "fp").limit(MOST_BUSY).collect()]
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = seen.withColumn("hot", is_hot).withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "place"), F.lit(parts))).otherwise(0))
    age = F.rank().over(Window.partitionBy("fp", "part", "rec").orderBy("doc", "place"))
    alike = Window.partitionBy("fp", "part")
    ranked = cut.withColumn("late", age > 1).withColumn("n", F.count("*").over(alike)).withColumn("varied", F.min("rec").over(alike) != F.max("rec").over(alike))
    kept = ranked.where("hot OR n > 1 AND (late OR varied)").select("fp", "rec", "doc", "place", F.col("late").alias("whole"), (F.col("hot") & ~F.col("late")).alias("open"))
    if not hot:
        return kept.select("fp", "doc", "place", "whole")
    kept = written(kept, "runs")
    firsts = kept.where("open")
    mixed_up = [r["fp"] for r in firsts.groupBy("fp").agg((F.min("rec") != F.max("rec")).alias("varied")).where("varied").collect()]
    ever = F.rank().over(Window.partitionBy("fp", "rec").orderBy("doc", "place"))
    settled = firsts.withColumn("whole", ever > 1).where(F.col("whole") | (F.col("fp").isin(mixed_up) if mixed_up else F.lit(False)))
    return kept.where("NOT open").union(settled).select("fp", "doc", "place", "whole")


def repeated_spans(docs: DataFrame, busy: int = BUSY_RUNS) -> DataFrame:
    """(doc, start, stop): byte ranges whose union is what to remove. ``docs`` has ``doc``, which has one text, and ``text``."""
    seen = written(repeated_anchors(docs.mapInArrow(anchored, "fp bigint, rec bigint, doc bigint, place bigint"), busy), "anchors")
    begin = F.expr("shiftright(place, 14) - (shiftright(place, 7) & 127)")
    whole = seen.where("whole").select("doc", begin.alias("start"), (begin + F.expr("place & 127") + WINDOW).alias("stop"))
    open_runs = seen.where("NOT whole")
    by_doc = open_runs.groupBy("doc").agg(F.collect_set(F.struct("fp", "place")).alias("runs"))
    found = docs.join(by_doc, "doc").dropDuplicates(["doc"]).mapInArrow(fetched, "fp bigint, doc bigint, start bigint, bytes binary")
    records = written(found, "records")
    hot = records.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > HOT_RECORDS)
    shards = max(1, records.count() // SHARD_RECORDS)
    dealt = records.join(hot, "fp", "left").withColumn("hot", F.col("n").isNotNull())
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "start"), F.ceil(F.col("n") / HOT_RECORDS))).otherwise(F.lit(0))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("fp", spread), F.lit(shards))).drop("n", "fp")
    kinds = "hot boolean, doc bigint, start bigint, stop bigint, one bigint, two bigint, shard bigint"
    # Few bytes are much work here, so partitions aren't put together by their bytes.
    repeats = written(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(shard_repeats, kinds), "repeats")
    spread_firsts = repeats.where("hot").withColumn("cell", F.expr(f"pmod(one, {shards})"))
    across = spread_firsts.groupBy("cell").applyInArrow(merged_repeats, "doc bigint, start bigint, stop bigint")
    return whole.union(repeats.where("NOT hot").select("doc", "start", "stop")).union(across)


def numbered(keyed: DataFrame) -> DataFrame:
    """``keyed`` (doc, text, ...) with a ``doc`` that no two different texts share.

    Ids mostly have one text, and stay. If any has several, all texts are numbered by id,
    then digest: ids and digests alone are sorted, over all tasks, and joined back.
    """
    marks = keyed.select("doc", F.unhex(F.sha2("text", 256)).alias("digest"))
    if marks.groupBy("doc").agg((F.min("digest") != F.max("digest")).alias("several")).where("several").isEmpty():
        return keyed
    order = written(marks.distinct().orderBy("doc", "digest").withColumn("number", F.monotonically_increasing_id()), "numbers")
    rest = [c for c in keyed.columns if c != "doc"]
    joined = keyed.withColumn("digest", F.unhex(F.sha2("text", 256))).join(order, ["doc", "digest"])
    return written(joined.select(F.col("number").alias("doc"), *rest), "numbered")


def drop_repeated_spans(docs: DataFrame, busy: int = BUSY_RUNS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes left).

    A byte goes if a 100-byte string over it also starts earlier, in a smaller doc_id or
    in the same text; strings are judged on the input. Null text is empty. A null doc_id
    counts as the smallest id. Rows that repeat an id with the same text are one
    document, and each gets its answer; different texts under one id are documents of
    their own, in the order of their SHA-256. Texts under 100 bytes hold no string.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = numbered(docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("bigint").alias("doc"), text.alias("text")))
    spans = repeated_spans(keyed.select("doc", "text"), busy).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = keyed.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
