"""Information-theoretic sanitisation: personal data by pattern, and the terms whose company gives it away.

Every distinct address, number or card is a protected entity c. The terms around its
mentions are counted over the corpus, and with them every document that holds such a term
t: the pointwise mutual information of c and t, as a share of the information that c itself
carries, is

    disclosure(c, t) = log2(D n(c, t) / (n(c) n(t))) / log2(D / n(c)),

1 if t never occurs but next to c, about 0 for a word that occurs anywhere. Terms above one
threshold are removed from the documents that mention c, terms above a lower one are
generalised to the kind of word that they are. A pair needs several different texts, so
copies of one text prove nothing, and documents without personal data are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lemmaflow.llm.bytescan import LOWER, buffers, groups_of_rows, lean, mixed, prefix_hashes
from lemmaflow.llm.columns import packed, without
from lemmaflow.llm.spans import before_each, let
from lemmaflow.plans.scratch import written, written_with

#: Terms on either side of a mention that count as its company, and different texts that a pair needs.
REACH, SUPPORT = 16, 3
#: Shares of an entity's information from which a term is generalised, and removed.
HINT, REVEAL = 0.75, 0.9
#: Places of the map that spares words no entity is near the shuffle: a megabyte.
MAP_BITS = 23
#: Counts that a task holds before it adds up equal ones; more if there are more different terms.
HELD_TERMS = 1 << 18

# The base kinds in their order; after them the method's.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "reveal", "hint"]
SHAPES = ["name", "number", "word"]
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(rb"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGITS = bytes(x for x in range(256) if not 48 <= x <= 57)
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TERM = np.zeros(256, dtype=bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True

SPAN = "struct<kind:int,start:int,stop:int,shape:int>"
SCANNED = f"digest binary, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base array<{SPAN}>, entities array<bigint>, pairs array<struct<entity:bigint,term:bigint>>, places array<struct<term:bigint,start:int,stop:int,shape:int>>"
ADDED = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Addresses, found from their @: what stands before it is read backwards, so a long run without one costs nothing."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        if (domain := DOMAIN.match(text, at + 1)) is not None:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find(b"@", at + 1)


def addresses(text: bytes) -> Iterator[tuple[int, int]]:
    """Four numbers at most 255; a longer chain of numbers gives its first four, then the next."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(b".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip(b"0")) < 4 and int(p or b"0") <= 255 for x in four):
                yield start, start + size
            start += size + 1


def luhn(digits: bytes) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[d - 48] if k % 2 else d - 48 for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base patterns, in bytes; their classes are ASCII, so bytes match as characters do."""
    out = [(0, *x) for x in emails(text)] + [(1, *x) for x in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].translate(None, NO_DIGITS)) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(m[0].translate(None, NO_DIGITS)) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def entity(kind: int, mention: bytes) -> int:
    """A number for what is mentioned, however it is written."""
    if kind == 1:
        value = b".".join(x.lstrip(b"0") for x in mention.split(b"."))
    else:
        value = mention.translate(None, NO_DIGITS) if kind else mention.lower()
    return int.from_bytes(hashlib.md5(b"%d %s" % (kind, value), usedforsecurity=False).digest()[:8], "big", signed=True)


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows laid end to end: each term's hash, A to Z lower-cased, its start and stop, and its row."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none
    inside = TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums, down = prefix_hashes(LOWER[data])
    return mixed((sums[stops] - sums[starts]) * down[starts]).view(np.int64), starts, stops, np.searchsorted(at, starts, side="right") - 1


def company(text: bytes, spans: list[tuple[int, int, int]]) -> tuple[list, list, list, list]:
    """A document's spans, entities, (entity, term) pairs and the places of those terms, in code points."""
    data = np.frombuffer(text, np.uint8)
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data & 0xC0 != 0x80, out=point[1:])
    term, starts, stops, _ = terms_of(data, np.array([0, len(data)]))
    covered = np.zeros(len(data) + 1, np.int32)
    for _, a, b in spans:
        covered[a] += 1
        covered[b] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    free = inside[stops] == inside[starts]
    term, starts, stops = term[free], starts[free], stops[free]
    entities, pairs = {}, {}
    for kind, a, b in spans:
        entities[c := entity(kind, text[a:b])] = None
        before, after = int(np.searchsorted(stops, a, side="right")), int(np.searchsorted(starts, b))
        for t in (*term[max(0, before - REACH) : before].tolist(), *term[after : after + REACH].tolist()):
            pairs[c, t] = None
    there = np.isin(term, np.unique(np.array([t for _, t in pairs], np.int64)))
    term, starts, stops = term[there], starts[there], stops[there]
    first = data[starts]
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    shape = np.where(digits[stops] - digits[starts] == stops - starts, 1, np.where((first >= 65) & (first <= 90), 0, 2))
    base = [(kind, int(point[a]), int(point[b]), 0) for kind, a, b in spans]
    return base, list(entities), list(pairs), list(zip(term.tolist(), point[starts].tolist(), point[stops].tolist(), shape.tolist(), strict=True))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's base spans, and what its entities are surrounded by."""
    lean()
    span = pa.struct([(c, pa.int32()) for c in ("kind", "start", "stop", "shape")])
    pair = pa.struct([("entity", pa.int64()), ("term", pa.int64())])
    place = pa.struct([("term", pa.int64()), *[(c, pa.int32()) for c in ("start", "stop", "shape")]])
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for k, stop in groups_of_rows(at):
            out: list[list] = [[] for _ in range(9)]
            for r in range(k, stop):
                text = data[at[r] : at[r + 1]].tobytes()
                spans = base_spans(text)
                found = company(text, spans) if spans else ([], [], [], [])
                counts = [sum(x[0] == kind for x in spans) for kind in range(len(BASE))]
                for column, value in zip(out, (hashlib.md5(text, usedforsecurity=False).digest(), *counts, *found), strict=True):
                    column.append(value)
            listed = lambda rows, of: pa.array([[dict(zip(of.names, x, strict=True)) for x in row] for row in rows], pa.list_(of))
            arrays = [pa.array(out[0], pa.binary()), *[pa.array(x, pa.int64()) for x in out[1:5]], listed(out[5], span), pa.array(out[6], pa.list_(pa.int64())), listed(out[7], pair), listed(out[8], place)]
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(k, stop - k), *arrays], names=["row", "digest", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "pairs", "places"])


def holders(asked: bytes):
    """A task that counts, of the terms whose place in the map ``asked`` is set, the documents that hold them: (term, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bits = np.frombuffer(asked, np.uint8)
        terms, sums, held, most = [], [], 0, HELD_TERMS
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for k, stop in groups_of_rows(at):
                term, _, _, row = terms_of(data[at[k] : at[stop]], at[k : stop + 1] - at[k])
                slot = term & ((1 << MAP_BITS) - 1)
                wanted = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                term, row = term[wanted], row[wanted]
                order = np.lexsort((row, term))
                term, row = term[order], row[order]
                fresh = np.ones(len(term), bool)
                fresh[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                found, n = np.unique(term[fresh], return_counts=True)
                terms.append(found)
                sums.append(n)
                held += len(found)
                if held > most:
                    terms, sums = added_up(terms, sums)
                    held = len(terms[0])
                    most = max(HELD_TERMS, 2 * held)
        if terms:
            terms, sums = added_up(terms, sums)
            for k in range(0, len(terms[0]), HELD_TERMS):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][k : k + HELD_TERMS]) for x in (terms, sums)], names=["term", "n"])

    return run


def added_up(terms: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The counts of equal terms as one."""
    found, which = np.unique(np.concatenate(terms), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, which, np.concatenate(sums))
    return [found], [total]


def map_of(terms: DataFrame) -> bytes:
    """A bit for each place that a term falls on; the same megabyte whatever the number of terms."""
    width = 8 * 4096
    slot = terms.select((F.col("term").bitwiseAND((1 << MAP_BITS) - 1)).alias("slot"))
    parts = slot.groupBy(F.expr(f"slot div {width}").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % width).alias("bits"))
    out = bytearray(1 << (MAP_BITS - 3))
    for r in parts.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(out)


def disclosures(found: DataFrame, docs: DataFrame, total: int, hint: float, reveal: float) -> DataFrame:
    """(digest, added): the spans in a text of terms that give away an entity which it mentions."""
    texts = found.where(F.size("pairs") > 0)
    near = texts.select("digest", F.explode("pairs").alias("p")).groupBy("digest", "p.entity", "p.term").agg(F.count(F.lit(1)).alias("n"))
    near = written(near, "near")
    pairs = near.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    pairs = written(pairs, "pairs")
    mentions = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    term_docs = docs.select("text").mapInArrow(holders(map_of(pairs)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    share = 1 - F.log2(F.col("n_term") / F.col("both")) / F.log2(F.lit(total) / F.col("n_entity"))
    judged = pairs.join(mentions.where(F.col("n_entity") < total), "entity").join(term_docs, "term").withColumn("share", share).where(F.col("share") >= hint)
    judged = written(judged.select("entity", "term", F.when(F.col("share") >= reveal, KINDS.index("reveal")).otherwise(KINDS.index("hint")).alias("kind")), "judged")
    hits = near.join(judged, ["entity", "term"]).groupBy("digest", "term").agg(F.min("kind").alias("kind"))
    where = texts.groupBy("digest").agg(F.first("places").alias("places")).select("digest", F.explode("places").alias("x")).select("digest", "x.*")
    spans = where.join(hits, ["digest", "term"]).select("digest", F.struct(*[F.col(c).cast("int").alias(c) for c in ("kind", "start", "stop", "shape")]).alias("span"))
    return spans.groupBy("digest").agg(F.collect_list("span").alias("added"))


def judged_rows(docs: DataFrame, names: list[str], hint: float, reveal: float) -> DataFrame:
    """(row, n_email, ..., base, found): the named columns packed, the base spans, and all spans by kind, then start."""
    rows = docs.select(packed(names), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([*rows.select("row").schema.fields, *StructType.fromDDL(SCANNED).fields])
    found, seen = written_with(rows.mapInArrow(scanned, schema), "found", n=F.count(F.lit(1)))
    added = disclosures(found, rows, seen["n"], hint, reveal)
    none = F.array().cast(f"array<{SPAN}>")
    out = found.drop("entities", "pairs", "places").join(added, "digest", "left")
    return out.withColumn("base", F.sort_array("base")).withColumn("found", F.sort_array(F.concat("base", F.coalesce("added", none))))


def listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_private(docs: DataFrame, hint: float = HINT, reveal: float = REVEAL, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with counts of the base kinds, the digest of their spans, and every span.

    ``found`` holds (kind number, start, stop, shape) in code points, stop exclusive, kinds
    as in ``KINDS``. Null and empty texts have no spans. Repeated rows count each as a
    document, but as one text for the support of a pair. A term that every document or
    few texts hold reveals nothing. Columns of ``docs`` stay, or those named by ``carry``,
    apart from those that have the names added here. An empty table stays empty.
    """
    counts = [F.col(c) for c in ADDED[:4]]
    return judged_rows(docs, without(docs, ADDED) if carry is None else carry, hint, reveal).select("row.*", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")


def sanitise(docs: DataFrame, hint: float = HINT, reveal: float = REVEAL) -> DataFrame:
    """``docs`` with personal data masked by its kind, revealing terms removed and hinting ones generalised to ``[name]``, ``[number]`` or ``[word]``.

    Spans that overlap give the first one's mask. All rows and columns stay; a text
    without spans stays as it is, null included. ``n_chars``, where there is one, is left
    to the caller.
    """
    df = judged_rows(docs, docs.columns, hint, reveal)
    masks = F.array(*[F.lit(f"[{k}]") for k in BASE], F.lit(""))
    shapes = F.array(*[F.lit(f"[{k}]") for k in SHAPES])
    mask = lambda x: F.when(x["kind"] < len(KINDS) - 1, F.get(masks, x["kind"])).otherwise(F.get(shapes, x["shape"]))
    text = F.col("row.`{}`".format({c.lower(): c for c in docs.columns}["text"]))
    by_place = F.sort_array(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["shape"].alias("shape"))))

    def pieces(spans: Column) -> Column:
        done = before_each(F.transform(spans, lambda x: x["stop"]), F.lit(0), lambda a, b: F.greatest(a, b))
        piece = lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), mask(x))).otherwise(F.lit(""))
        rest = let(F.array_max(F.transform(spans, lambda x: x["stop"])), lambda at: F.substring(text, at + 1, F.length(text)))
        return F.concat(F.array_join(F.zip_with(spans, done, piece), ""), rest)

    clean = F.when(F.size("found") > 0, let(by_place, pieces)).otherwise(text)
    return df.select(*[clean.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
