"""Sanitisation and the two audits against plain versions, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from lemmaflow.llm import auditsql, filteraudit, sanitise, sourceaudit
from tests.llm.test_operators import lowered, sentence, texts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(None, "Null Id", "en", "s0", 1), (None, "Null Id", "en", "s0", 1), (7, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (3, " \t\n", "xx", "s9", 3), (900, "A$ " * 20000, "en", "s1", 60000)]


def rows_of(seed=5):
    rng = random.Random(seed)
    out = [(k, t, rng.choice(["en", "de", None]), f"s{0 if k % 3 == 0 else k % 4}", len(t or "")) for k, t in enumerate(texts(seed=seed))]
    out += [(100 + k, sentence(rng, 130) + rng.choice(["", " É", "$ AB"]), "en", "s1", 0) for k in range(20)]
    return [*out, *ODD, out[4], out[4]]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    cells = collections.Counter()
    for d, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t) is not None, d is not None and least[t] < d]
        cells[lang or "", frozenset(k for k, f in zip("ABCDE", fails, strict=True) if f), d in good, d in toxic] += 1
    out = {}
    for part in {p for p, *_ in cells}:
        own = {k[1:]: n for k, n in cells.items() if k[0] == part}
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for at, f in enumerate(order):
                before = set(order[:at])
                here = {k: n for k, n in own.items() if not k[0] & before}
                gone = {k: n for k, n in here.items() if f in k[0]}
                shapley[f] += sum(gone.values())
                counts = [sum(here.values()) - sum(gone.values()), sum(gone.values()), sum(n for k, n in own.items() if f in k[0] and k[0] & before), sum(n for k, n in own.items() if k[0] == {f}), sum(n for k, n in gone.items() if k[1]), sum(n for k, n in gone.items() if k[2])]
                out[part, "".join(order), at + 1] = counts
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_filter_audit(spark, rows):
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 110)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{DOCS}, mask string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filteraudit.audit_filters(docs, marks).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:6]) + list(r[6:]) for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert filteraudit.audit_filters(docs.limit(0), marks).count() == 0


def test_plain_changes_visit_every_order_by_one_swap():
    order, seen = list(range(5)), {tuple(range(5))}
    for k in filteraudit.plain_changes(5):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == 120 and not list(filteraudit.plain_changes(1))


def plain_divergence(rows):
    found, docs = collections.Counter(), collections.Counter()
    groups = set()
    for _, t, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
        found.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= 3)
        own = sorted(s for g, s in groups if g == lang)

        def p(counts, kept=kept):
            total = sum(counts)
            return [1 + 10**9 * (c + 1) // (total + len(kept)) for c in counts]

        of = {s: [found[lang, s, w] for w in kept] for s in own}
        ps = {s: p(c) for s, c in of.items()}
        q = p([sum(x) for x in zip(*of.values(), strict=True)])
        for s in own:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(ps[s], ps[o], strict=True)), o.encode()) for o in own if o != s]
            terms = [(-((a - b) ** 2 // b), w.encode()) for a, b, w, n in zip(ps[s], q, kept, of[s], strict=True) if n and a > b]
            out |= {(lang, s, part, item.decode(), -v, k) for part, xs in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])) for k, (v, item) in enumerate(xs, 1)}
    return out


@pytest.mark.parametrize("shards", [1, 5])
def test_source_audit(spark, rows, monkeypatch, shards):
    monkeypatch.setattr(sourceaudit, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(sourceaudit, "COMPACT_ROWS", 200)
    more = [*rows, *[(1000 + k, "É é Éa\x00b x-y " * 3 + "Ünï", "fr", f"f{k % 3}", 0) for k in range(6)], (2000, "alone", "zz", "z1", 0), (2001, None, "zz", "z2", 0)]
    docs = spark.createDataFrame([(*r, 0, "y") for r in more], f"{DOCS}, n int, item string")
    assert {tuple(r) for r in sourceaudit.audit_sources(docs, shards).collect()} == plain_divergence(more)
    assert sourceaudit.audit_sources(docs.limit(0)).count() == 0


def test_audits_as_sql(spark, rows):
    db = duckdb.connect()
    docs, marks = spark.createDataFrame([r for r in rows if r[0] is not None], DOCS), spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(50)], "doc_id bigint, quality int, toxic int")
    db.register("documents", docs.toArrow())
    db.register("labels", marks.toArrow())
    for mine, sql in ((filteraudit.audit_filters(docs, marks), auditsql.FILTER_AUDIT), (sourceaudit.audit_sources(docs), auditsql.SOURCE_AUDIT)):
        assert sorted(map(tuple, mine.collect())) == sorted(db.sql(sql).project(", ".join(mine.columns)).fetchall())


# The base patterns as given.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in s.split("."))) or (kind == "phone" and 8 <= len(digits) <= 15)


def plain_base(t):
    return [(k, m.start(), m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], t) if passes(kind, m[0])]


def plain_sanitation(rows, hint=sanitise.HINT, reveal=sanitise.REVEAL):
    value = lambda kind, s: (kind, s.lower() if kind == 0 else ".".join(str(int(x)) for x in s.split(".")) if kind == 1 else re.sub("[^0-9]", "", s))
    near, mentions, holds, supports = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    kept = []
    for _, t in rows:
        t = t or ""
        base = plain_base(t)
        words = [(lowered(m[0]), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        holds.update({w for w, *_ in words})
        free = [x for x in words if not any(a < x[2] and x[1] < b for _, a, b in base)]
        pairs = set()
        for kind, a, b in base:
            around = [x[0] for x in free if x[2] <= a][-sanitise.REACH :] + [x[0] for x in free if x[1] >= b][: sanitise.REACH]
            pairs |= {(value(kind, t[a:b]), w) for w in around}
        mentions.update({value(k, t[a:b]) for k, a, b in base})
        near.update(pairs)
        for p in pairs:
            supports[p].add(t)
        kept.append((t, base, free, pairs))
    out = []
    for t, base, free, pairs in kept:
        level = {}
        for c, w in pairs:
            if len(supports[c, w]) >= sanitise.SUPPORT and mentions[c] < len(rows):
                share = 1 - math.log2(holds[w] / near[c, w]) / math.log2(len(rows) / mentions[c])
                if share >= hint:
                    level[w] = min(level.get(w, 9), 4 if share >= reveal else 5)
        listed = ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for k, a, b in sorted([*base, *[(level[w], a, b) for w, a, b in free if w in level]]))
        shown = ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for k, a, b in base)
        out.append((*[sum(x[0] == k for x in base) for k in range(4)], hashlib.sha256(shown.encode()).hexdigest(), listed))
    return out


def test_base_spans_of_odd_texts():
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", ".", "%", "-", "1", "22", "255", "256", "0001", "+", " ", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "+1 (555) 010-9999", "x@y.z", "é", "\n", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        data = t.encode()
        point = lambda k, data=data: len(data[:k].decode())
        assert sorted((k, point(a), point(b)) for k, a, b in sanitise.base_spans(data)) == plain_base(t), t
    for long in (b"a" * 2_000_000, b"1" * 2_000_000, b"1." * 500_000, b"a@" * 500_000, b"+1" + b" " * 500_000, b"1 " * 500_000):
        assert all(k in (1, 3) for k, *_ in sanitise.base_spans(long))


@pytest.fixture(scope="module")
def private():
    rng = random.Random(8)
    out = [(k, sentence(rng, 60)) for k in range(60)]
    for k in range(8):
        out.append((100 + k, f"{sentence(rng, 30)} Reach Zorblax at zorblax.{k % 2}@mail.example.com or +1 (555) 010-99{k % 2}9 ünï{k} {sentence(rng, 30)}"))
    copy = "one Quuxly text of its own, quuxly@a.example and 4111 1111 1111 1111 near 10.0.0.1 " + sentence(rng, 20)
    return [*out, *[(200 + k, copy) for k in range(5)], (501, None), (502, ""), (None, "call +1 555 0100 999"), (300, "Zorblax alone"), (301, "x " * 100000 + "zorblax.0@mail.example.com Zorblax " + "é " * 1000)]


def test_sanitisation(spark, private, monkeypatch):
    monkeypatch.setattr(sanitise, "HELD_TERMS", 50)
    docs = spark.createDataFrame([(*r, "x", "y") for r in private], "doc_id bigint, text string, kind string, digest string")
    for hint, reveal in ((sanitise.HINT, sanitise.REVEAL), (0.3, 0.6)):
        got = [tuple(r) for r in sanitise.scan_private(docs, hint, reveal).select("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()]
        expected = plain_sanitation(private, hint, reveal)
        assert collections.Counter(got) == collections.Counter(expected)
        assert any("reveal" in x[-1] for x in expected) or any("hint" in x[-1] for x in expected)
    assert not any("reveal" in s or "hint" in s for (_, t), (*_, s) in zip(private, expected, strict=True) if not plain_base(t or ""))
    assert sanitise.scan_private(docs.limit(0)).count() == 0 and sanitise.scan_private(docs).columns[:4] == docs.columns


def test_sanitised_texts(spark, private):
    docs = spark.createDataFrame([(*r, "x") for r in private], "doc_id bigint, Text string, found string")
    got = sanitise.sanitise(docs, 0.3, 0.6)
    assert got.columns == docs.columns
    spans = {r.doc_id: r.spans for r in sanitise.scan_private(docs.select("doc_id", "Text"), 0.3, 0.6).collect()}
    was = dict(private)
    for r in got.collect():
        assert r.found == "x" and (spans[r.doc_id] or r.Text is None or r.Text == was[r.doc_id])
        if r.Text:
            assert not plain_base(r.Text)
    one = next(r.Text for r in got.collect() if r.doc_id == 100)
    assert "[email]" in one and "[phone]" in one and "Zorblax" not in one


def test_terms_of_rows_laid_end_to_end():
    rows = ["ab", "cd É", "", "é", "x1-y"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.cumsum([0, *[len(r.encode()) for r in rows]])
    terms, row = sourceaudit.terms_of(data, at)
    assert list(zip(terms.to_pylist(), row.tolist(), strict=True)) == [("ab", 0), ("cd", 1), ("É", 1), ("é", 3), ("x", 4), ("y", 4)]
    _, starts, stops, row = sanitise.terms_of(data, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, stops, strict=True)] == ["ab", "cd", "É", "é", "x1", "y"] and row.tolist() == [0, 1, 1, 3, 4, 4]
