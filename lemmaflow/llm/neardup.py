"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles. Every shingle spawns Poisson points
whose rate is its weight, over dyadic slices of the weight axis; the least point in each
register is the signature, so two texts agree in a register with probability equal to
their weighted Jaccard similarity. Bands of registers give candidates, and shared
shingles, counted with multiplicity, decide. Links merge into classes. A bucket is never
paired out: members are compared with its leader first, and those outside the leader's
class meet others only through a shingle that both hold and that an exact prefix filter
lets stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.bytescan import ODD, buffers, groups_of_rows, lean, mixed, word_hashes
from lemmaflow.llm.columns import unused
from lemmaflow.plans.components import connected_components
from lemmaflow.plans.scratch import written

SHINGLE = 5
BANDS = 48
ROWS = 8
SIMILARITY = (4, 5)
#: Times that the members left over choose a new leader in each bucket before they are compared one by one.
LEADERS = 2
#: Slots of the map of documents to be compared: 2^23 bits, 1 MB whatever the input.
SLOTS = 1 << 23
DOC_BITS = np.uint64(52)
#: Longs of a text's parity sketch.
SKETCH = 8


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` neighbouring words of a row, and the row of each; a shorter text with words is one shingle."""
    if not len(words):
        return words, rows
    total = np.bincount(rows, minlength=n_rows)
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    short = total[rows] < size
    same = np.concatenate([rows, np.full(size - 1, -1)])
    mix = np.zeros(len(words), np.uint64)
    for k in range(size):
        inside = same[k : k + len(words)] == rows
        mix = mixed(mix * ODD + np.where(inside, padded[k : k + len(words)], np.uint64(k + 1)))
    first = np.zeros(len(words), bool)
    first[np.unique(rows, return_index=True)[1]] = True
    whole = same[size - 1 : size - 1 + len(words)] == rows
    use = whole | (short & first)
    return mix[use], rows[use]


def multiset(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with multiplicity, in row order. Rows number under 4,096, so both fit one word."""
    packed = np.sort((rows.astype(np.uint64) << DOC_BITS) | (hashes >> np.uint64(12)))
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    return packed & np.uint64((1 << 52) - 1), (packed >> DOC_BITS).astype(np.int64), counts


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def bag_minhash(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Registers of every row: the least Poisson point that fell there; infinite for rows without shingles.

    The weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each slice has
    a process of its own whose rate is its width; a point counts if its level is under
    the weight. Points come in ascending order, so a row is done once its registers are
    full and the next points lie beyond a bound; rows still open get a larger bound.
    """
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    own = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    floor = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    width = np.where(level == 0, 1.0, floor)
    key = mixed(hashes[own] + level.astype(np.uint64) * ODD)
    row, top = rows[own], weights[own].astype(np.float64)
    out = np.full(n_rows * registers, np.inf)
    mass = np.bincount(rows, weights=weights, minlength=n_rows)
    at = np.zeros(len(own))
    step = np.zeros(len(own), np.uint64)
    bound = registers / np.maximum(mass, 1) * (np.log(registers) + 3.0)
    todo = np.arange(len(own))
    while len(todo):
        live, parked = todo, []
        while len(live):
            step[live] += np.uint64(1)
            h = mixed(key[live] ^ (step[live] * np.uint64(0xA24BAED4963EE407)))
            ahead = at[live] - np.log(uniform(h)) / width[live]
            late = ahead > bound[row[live]]
            step[live[late]] -= np.uint64(1)
            parked.append(live[late])
            live, h, ahead = live[~late], h[~late], ahead[~late]
            at[live] = ahead
            g = mixed(h + ODD)
            counts = floor[live] + uniform(mixed(g)) * width[live] <= top[live]
            np.minimum.at(out, row[live][counts] * registers + (g[counts] % np.uint64(registers)).astype(np.int64), ahead[counts])
        open_rows = np.isinf(out.reshape(n_rows, registers)).any(axis=1) & (mass > 0)
        bound[open_rows] *= 2.0
        todo = np.concatenate(parked)
        todo = todo[open_rows[row[todo]]]
    return out.reshape(n_rows, registers)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: id, digest of the text, number of shingles, one hash for each band."""
    lean()
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for a, b in groups_of_rows(at):
            n = b - a
            words, rows = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
            h, r, w = multiset(*shingles(words, rows, n))
            mass = np.bincount(r, weights=w, minlength=n).astype(np.int64)
            points = bag_minhash(h, r, w, n, BANDS * ROWS).view(np.uint64).reshape(n, BANDS, ROWS)
            bands = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                bands = mixed(bands * ODD + points[:, :, k])
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), batch.column("digest").slice(a, n), pa.array(mass), lists], names=["doc_id", "digest", "mass", "bands"])


def parities(codes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Of each row, whether an odd number of its codes fell on each of 64 ``SKETCH`` bits.

    Where two rows' bits differ, a code of one is none of the other's; so the number of
    different bits is at most the number of codes that only one of them has.
    """
    width = 64 * SKETCH
    odd = np.bincount(rows * width + (codes & (width - 1)), minlength=n_rows * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_rows, width), axis=1).view(np.int64)


def occurrences(slots: np.ndarray) -> Callable:
    """Codes rows whose slot is set: digest and one number for each shingle occurrence, so that a multiset becomes a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((slots[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            data, at = buffers(batch.column("text"))
            for a, b in groups_of_rows(at):
                n = b - a
                words, rows = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
                h, r, w = multiset(*shingles(words, rows, n))
                turn = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                codes = mixed(np.repeat(h, w) + turn.astype(np.uint64) * ODD).view(np.int64)
                stops = np.concatenate([[0], np.cumsum(np.bincount(r, weights=w, minlength=n))]).astype(np.int32)
                sketch = pa.FixedSizeListArray.from_arrays(pa.array(parities(codes, np.repeat(r, w), n).ravel()), SKETCH).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, n), pa.ListArray.from_arrays(pa.array(stops), pa.array(codes)), sketch], names=["digest", "codes", "sketch"])

    return run


def slot_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def slots_set(members: DataFrame) -> np.ndarray:
    """A map of ``SLOTS`` bits in which the slot of every ``digest`` is set.

    A row without its slot set is none of ``members``, so its text needs no shuffle. Other
    rows may pass and must be told apart later. Parts of 4 KB come to the driver, 256 at most.
    """
    width = 1 << 15
    slot = members.select(slot_of("digest").alias("slot"))
    parts = slot.groupBy((F.expr(f"slot div {width}")).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % width).alias("bits"))
    out = np.zeros((SLOTS // width, width // 8), np.uint8)
    for row in parts.collect():
        out[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def crowded_buckets(reps: DataFrame) -> DataFrame:
    """(band, digest, mass, rank, lead, lead_mass, n): members of the buckets that hold more than one text, with the bucket's leader.

    The member that meets most others over all of its buckets leads: of a group of
    copies, that is one near the middle, so that a star from it links nearly all. ``rank``
    orders members that way, ties going to the least id. Counts and leaders are partial
    aggregates joined back, so that a bucket of any size is spread over tasks.
    """
    hashed = reps.withColumn("h", F.xxhash64("digest"))
    buckets = hashed.select("h", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets.join(shared, "band"), "buckets")
    members = buckets.groupBy("h").agg((-F.sum("n")).alias("met")).join(hashed.select("h", "digest", "doc_id", "mass"), "h")
    members = written(members.select("h", "digest", "mass", F.struct("met", "doc_id", "digest").alias("rank")), "members")
    return written(led(buckets.join(members, "h").drop("h")), "crowded")


def led(members: DataFrame) -> DataFrame:
    """``members`` (band, digest, mass, rank, ...) with each bucket's first member by rank as ``lead`` and ``lead_mass``."""
    first = members.groupBy("band").agg(F.min_by(F.struct("digest", "mass"), "rank").alias("x"))
    return members.join(first.select("band", F.col("x.digest").alias("lead"), F.col("x.mass").alias("lead_mass")), "band")


def star_pairs(crowded: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's leader, where their sizes allow the similarity."""
    pairs = crowded.where("digest <> lead").where(sizes_fit("mass", "lead_mass"))
    return pairs.select(F.least("lead", "digest").alias("a"), F.greatest("lead", "digest").alias("b")).distinct()


def sizes_fit(x: str, y: str) -> Column:
    a, b = SIMILARITY
    return (F.least(x, y) * b) >= (F.greatest(x, y) * a)


def verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs whose multisets overlap enough."""
    a, b = SIMILARITY
    left = codes.select(F.col("digest").alias("a"), F.col("codes").alias("x"))
    right = codes.select(F.col("digest").alias("b"), F.col("codes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return joined.where(F.col("both") * b >= (F.col("all") - F.col("both")) * a).select("a", "b")


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest), null text as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (least id of its class), ``class_size`` and ``is_kept``.

    Texts, not ids, are compared. Equal texts share a class without being paired; between
    different texts every bucket's members are checked, first against its leader, then,
    for members outside its class, against all others through an exact prefix filter.
    Words are runs other than space, tab, line breaks, vertical tab and form feed, with A
    to Z lower-cased; a text of one to four words is one shingle; null texts and texts
    without words are alone in their class. Rows that repeat an id count as that document
    again, each with its own text; a null id gets a null class. ``is_kept`` holds for the
    document that stands for its class: the least id, and of several texts under that id
    the one with the least digest.
    """
    return classified(docs).drop("digest")


def classified(docs: DataFrame) -> DataFrame:
    """What ``near_duplicates`` returns, and the text's ``digest``."""
    rows = digested(docs)
    signs = written(rows.mapInArrow(signed, "doc_id bigint, digest binary, mass bigint, bands array<bigint>"), "bag-minhash")
    reps = signs.where("mass > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("mass").alias("mass"), F.first("bands").alias("bands"))
    reps = written(reps, "texts")
    crowded = crowded_buckets(reps)
    wanted = crowded.select("digest").distinct()
    slotted = rows.where("doc_id IS NOT NULL").select("digest", "text", slot_of("digest").alias("slot"))
    coded = slotted.mapInArrow(occurrences(slots_set(wanted)), "digest binary, codes array<bigint>, sketch array<bigint>")
    codes = written(coded.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("codes").alias("codes"), F.first("sketch").alias("sketch")), "shingles")
    links = all_links(crowded, codes)
    labels = connected_components(links).select(F.col("id").alias("digest"), "label")
    texts = reps.select("digest", "doc_id", "copies").join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    first = F.min(F.struct("doc_id", "digest"))
    classes = texts.groupBy("label").agg(first.alias("x"), F.sum("copies").alias("class_size"))
    by_text = texts.select("digest", "label").join(classes, "label").select("digest", F.col("x.doc_id").alias("class_id"), F.col("x.digest").alias("kept"), "class_size")
    out = signs.select("doc_id", "digest", F.when(F.col("mass") > 0, F.col("digest")).alias("d")).join(by_text.withColumnRenamed("digest", "d"), "d", "left")
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_size", F.lit(1))).otherwise(F.lit(1)).alias("class_size"),
        F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("kept")), F.lit(True)).alias("is_kept"),
        "digest",
    )


def all_links(crowded: DataFrame, codes: DataFrame) -> DataFrame:
    """The links (a, b) that make the classes: stars around leaders, then whatever a member outside its leader's class has with others."""
    pairs = written(star_pairs(crowded), "pairs")
    links = written(verified(pairs, codes), "links")
    named = labelled(crowded, links)
    for _ in range(LEADERS - 1):
        outside = led(named.where("outside").drop("lead", "lead_mass"))
        more = star_pairs(outside).join(pairs, ["a", "b"], "left_anti")
        pairs, links = pairs.union(more := written(more, "pairs")), links.union(written(verified(more, codes), "links"))
        named = labelled(crowded, links)
    rest = straggler_pairs(named, codes).join(pairs, ["a", "b"], "left_anti")
    return links.union(written(verified(rest, codes), "links"))


def labelled(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """``crowded`` with each member's ``label`` so far, and whether it lies ``outside`` the class of its bucket's leader."""
    label = connected_components(links).select(F.col("id").alias("digest"), "label")
    own = crowded.join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    lead = label.select(F.col("digest").alias("lead"), F.col("label").alias("lead_label"))
    return written(own.join(lead, "lead", "left").withColumn("outside", F.col("label") != F.coalesce("lead_label", "lead")).drop("lead_label"), "named")


def straggler_pairs(named: DataFrame, codes: DataFrame) -> DataFrame:
    """Pairs still to be checked: members outside the class of a bucket's leader, against all others under that leader.

    Two members inside are in one class already, so these are all. Of two sets that
    overlap enough, each lacks at most a fifth of its own codes in the other, so among a
    fifth and one more, in one order for both, there is a common one. That order puts
    codes that the leader lacks first: what all members share, because it put them into
    one bucket, comes last and joins nobody. Sizes, the common code's place and the parity
    sketches bound the overlap from above before a pair is made.
    """
    a, b = SIMILARITY
    bands = named.where("outside AND n > 2").select("band").distinct()
    near = named.join(bands, "band", "left_semi").groupBy("lead", "digest", "mass", "label").agg(F.max("outside").alias("outside"))
    near = written(near, "near")
    own, led_by = codes.select("digest", "codes", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]), codes.select(F.col("digest").alias("lead"), F.col("codes").alias("known"))
    order = F.concat(F.sort_array(F.array_except("codes", "known")), F.sort_array(F.array_intersect("codes", "known")))
    length = (F.col("mass") - F.expr(f"(mass * {a} + {b - 1}) div {b}") + 1).cast("int")
    heads = near.join(own, "digest").join(led_by, "lead").select("lead", "digest", "mass", "label", "outside", *[f"s{k}" for k in range(SKETCH)], F.posexplode(F.slice(order, F.lit(1), length)).alias("at", "code"))
    heads = written(heads, "prefixes")
    first = heads.where("outside").select("lead", "code", F.col("digest").alias("u"), F.col("label").alias("u_label"), F.col("mass").alias("u_mass"), F.col("at").alias("u_at"), *[F.col(f"s{k}").alias(f"u{k}") for k in range(SKETCH)])
    once = ~F.col("outside") | (F.col("u") < F.col("digest"))
    shared = heads.join(first, ["lead", "code"]).where("label <> u_label").where(once & sizes_fit("mass", "u_mass") & rest_fits() & sketches_fit())
    return written(shared.select(F.least("u", "digest").alias("a"), F.greatest("u", "digest").alias("b")).distinct(), "pairs")


def rest_fits() -> Column:
    """Whether the codes from a common one on suffice; it holds at the first common code of every pair that overlaps enough."""
    a, b = SIMILARITY
    return F.least(F.col("mass") - F.col("at"), F.col("u_mass") - F.col("u_at")) * (a + b) >= (F.col("mass") + F.col("u_mass")) * a


def sketches_fit() -> Column:
    """Whether so few bits of the sketches differ that the rest may be common to both."""
    a, b = SIMILARITY
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"u{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("s0").bitwiseXOR(F.col("u0"))))
    return differ * (a + b) <= (F.col("mass") + F.col("u_mass")) * (b - a)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one that ``near_duplicates`` marks. Rows without an id all stay."""
    mark = unused("digest", docs.columns)
    keep = classified(docs).where("is_kept AND doc_id IS NOT NULL").select("doc_id", F.col("digest").alias(mark)).distinct()
    rows = docs.where("doc_id IS NOT NULL").withColumn(mark, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    stay = rows.join(keep, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return stay.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
