"""Columns with clashing names, repeated ids, very long texts, and plain versions of what the operators decide."""

import hashlib
import json
import math
import random
import re
import struct
import time
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from lemmaflow.llm import decontaminate, exactspans, licenses, mainhtml, mixing, neardup, quality, secrets, suffixtree, toxicity
from lemmaflow.llm.columns import unused
from tests.llm.test_operators import LOWER, exact_spans, sentence, split, texts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INTERNAL = "n k m j h at phase row text2 _source _hash _tie _n _q _bin _rank _begin _w _b _s _f _l _t _g _x _h _p _digest digest band code codes key base weak open maybe f w found spans p_toxic p_insult toxic label labels score detections block slot position llr kept n_words item_id S0".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts(seed=11, n=40))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(40)], "doc_id bigint, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic AS int) AS toxic")


def test_any_column_name_is_carried(spark, docs, marks):
    wide = docs.selectExpr("*", *[f"concat('{c} of ', doc_id) AS `{c}`" for c in INTERNAL])
    benchmark = spark.createDataFrame([(1, texts(seed=11, n=40)[3])], "item_id bigint, text string")
    for run in (
        lambda d: toxicity.drop_toxic(d, d, marks),
        lambda d: quality.score_quality(d, marks),
        mixing.mix_sources,
        licenses.scan_licenses,
        secrets.scan_secrets,
        secrets.redact,
        neardup.keep_one,
        lambda d: decontaminate.drop_leaks(d, benchmark),
        lambda d: toxicity.score_toxicity(d, marks, carry=["doc_id", *INTERNAL]),
    ):
        out = run(wide)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        mine = [c for c in INTERNAL if dict(out.dtypes).get(c) == "string"]
        assert len(mine) >= len(INTERNAL) - 8
        for r in out.select("doc_id", *[f"`{c}`" for c in mine if c not in ("labels", "spans")]).collect():
            assert all(v == f"{c} of {r.doc_id}" for c, v in r.asDict().items() if c != "doc_id")
    assert set(INTERNAL) <= set(secrets.redact(wide).columns) and set(INTERNAL) <= set(neardup.keep_one(wide).columns) and set(INTERNAL) <= set(toxicity.drop_toxic(wide, wide, marks).columns)
    assert unused("x", ["_X", "__x"]) == "___x"


def test_different_texts_under_one_id(spark):
    b = " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(60))
    rows = spark.createDataFrame([(1, c), (2, b), (2, "zz " + c), (3, "yy " + b), (3, "yy " + b)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in exactspans.drop_repeated_spans(rows).collect())
    assert got == [(1, len(c), 0), (2, len(b), 0), (2, len(c) + 3, len(c)), (3, len(b) + 3, len(b)), (3, len(b) + 3, len(b))]
    near = sorted((r.doc_id, r.class_id, r.class_size, r.is_kept) for r in neardup.near_duplicates(rows).collect())
    assert near == [(1, 1, 2, True), (2, 1, 2, False), (2, 2, 3, True), (3, 2, 3, False), (3, 2, 3, False)]
    assert sorted(r.doc_id for r in neardup.keep_one(rows).collect()) == [1, 2]


@pytest.mark.parametrize("busy", [100_000, 3])
def test_thousands_of_texts_without_an_id(spark, busy):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    twice, line = word(150), word(130)
    texts_ = [word(rng.randrange(60, 200)) for _ in range(1500)] + [twice + word(9) + twice] + [word(20) + line + word(k % 7) for k in range(500)]
    rows = [(None, t) for t in texts_] + [(7, t) for t in texts_[1400:1600]] + [(3, texts_[1999]), (3, texts_[1999]), (4, line + "x"), (4, line + "y")]
    number = {k: n for n, k in enumerate(sorted({(-1 if d is None else d, hashlib.sha256(t.encode()).digest()) for d, t in rows}))}
    numbered = [(number[-1 if d is None else d, hashlib.sha256(t.encode()).digest()], t) for d, t in rows]
    want = exact_spans(sorted(set(numbered)))
    got = exactspans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), busy=busy).collect()
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted((d or -1, *want[n]) for (d, _), (n, _) in zip(rows, numbered, strict=True))
    assert want[number[-1, hashlib.sha256(texts_[1500].encode()).digest()]][1] >= 150


def test_many_parts_of_one_text_are_linked_in_linear_time(spark):
    text = "".join(f"user=abc{k} " + ("https://h.example/x " if k % 2 else "\n\n") for k in range(50_000))
    began = time.time()
    found = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().found
    assert time.time() - began < 60
    assert len(found) == 50_000 + 25_000 - 1  # the first stands alone in its paragraph


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<a " * 1_700_000, None),
        ("<a " * 1_700_000 + "><p>x</p>", "x"),
        ('<a "' * 1_000_000 + "><p>x</p>", "x"),
        ("<div>" * 100_000 + "x", "x"),
        ("<div>" * 100_000 + "x" + "</div>" * 100_000 + "<p>y</p>", "x"),
        ("<nav>" * 50_000 + "no" + "</nav>" * 50_000 + "<p>y</p>", "y"),
        ("<svg>" * 100_000 + "<p>y</p>", "y"),
        ("<!--" * 500_000, ""),
        ("<p>y</p><!x" + "<!x" * 500_000, None),
        ("<i>" * 50_000 + "</b>" * 50_000 + "y", "y"),
        ("<p>y " + "&amp;" * 200_000, "y " + "&" * 200_000),
    ],
)
def test_pages_that_are_broken_or_deep_take_seconds(source, text):
    began = time.time()
    page = mainhtml.Page(source)
    best = page.best()
    got = page.along({best[0]} if best else set()) or page.along(set())
    assert time.time() - began < 20 and (text is None or got == text)


@pytest.mark.parametrize("name", ["social-policy", "share-price", "related-work", "menu-history", "alert-levels", "banner-art", "comments-on-law"])
def test_a_noise_word_in_a_class_of_an_article_is_no_noise(name):
    page = mainhtml.Page(f"<body><nav>no</nav><article><p>One two three.</p><section class='{name}'><p>Four five six.</p></section><div class='share-buttons'>no</div><div class='comments'><p>no</p></div><div class='ad-300x250'>no</div><div id='related_posts'>no</div></article><div class='{name}'>no</div></body>")
    assert page.along({page.best()[0]}) == "One two three.\nFour five six."


def test_texts_of_several_megabytes(spark, marks):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(400_000))
    leak = " ".join(rng.choice(vocabulary) for _ in range(40))
    long = long[:1_500_000] + " " + leak + " AKIA" + "Q" * 16 + " licensed under the mit license " + long[1_500_000:]
    rows = spark.createDataFrame([(1, long, "en", "a", 1), (2, long[:-300] + sentence(rng, 40), "en", "a", 1), (3, sentence(rng, 90), "en", "b", 1)], DOCS)
    spans = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in exactspans.drop_repeated_spans(rows).collect()}
    assert spans[1][1] == 0 and spans[2][1] == len(long) - 300 and spans[3][1] == 0
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3}
    benchmark = spark.createDataFrame([(7, leak)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(rows, benchmark).collect()) == [(1, 7), (2, 7)]
    assert {r.doc_id: r.n_tokens for r in suffixtree.score_texts(rows).collect()}[1] == len(long.split()) + 1
    assert {r.doc_id: r.n_access for r in secrets.scan_secrets(rows).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(rows).collect()} == {1: "mit", 2: "mit", 3: ""}
    assert {r.doc_id: r.n_words for r in quality.score_quality(rows, marks).collect()}[1] == len(long.split())


PARTS = ["user: bob{k}", "client_id = c{k}xyz", "https://h{k}.example/x", "Ab1" + "q" * 18 + "{k}", "A" * 70 + "b1{k}", "token=abcdef{k}", "AKIA" + "Z" * 16, "0a" * 13, "plain words here", "\n\n", "x" * 150, "y" * 90, "secret: q", "a=b"]


def test_linked_parts_against_every_pair(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choice(PARTS).format(k=rng.randrange(99)) for _ in range(rng.randrange(1, 14)))) for k in range(150)]
    rows += [(900, rows[3][1]), (901, None), (902, "")]
    got = {r.doc_id: r.found for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    base = [r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", secrets.ACCESS, secrets.HEX]
    linked = 0
    for k, t in rows:
        t = t or ""
        strong = [(m.start(), i, m.end()) for i, p in enumerate(base) for m in re.finditer(p, t) if i or len(m[2]) >= 6]
        weak = [(m.start(), i, m.end()) for i, (kind, p) in enumerate(secrets.WEAK, 3) for m in re.finditer(p, t) if kind != "opaque" or all(re.search(x, m[0]) for x in secrets.MIXED)]
        breaks = [m.start() for m in re.finditer(secrets.BREAK, t)]
        role = lambda x: secrets.ROLE[secrets.KINDS[x[1]]]
        over = lambda a, b: b[0] < a[2] and a[0] < b[2]
        near = lambda a, b: b[0] <= a[2] + 200 and a[0] <= b[2] + 200
        apart = lambda a, b: any(min(a[2], b[2]) <= c < max(a[0], b[0]) for c in breaks)
        kept = [a for a in weak if not any(over(a, b) for b in strong) and any(role(a) != role(b) and near(a, b) and not over(a, b) and not apart(a, b) for b in strong + weak)]
        linked += len(kept)
        assert [(x.start, x.kind, x.stop) for x in got[k]] == sorted(strong + kept), (k, t)
    assert linked > 100


def test_more_matches_than_one_piece_of_a_running_sum(spark):
    t = "é token=abcdef1 " * 1500
    r = secrets.scan_secrets(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()
    assert r.n_assign == 1500 and [(x.start, x.stop) for x in r.found] == [(16 * k + 2, 16 * k + 15) for k in range(1500)]
    clean = secrets.redact(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()
    assert clean.text == "é [secret] " * 1500
    x = licenses.scan_licenses(spark.createDataFrame([(1, "mit license foo " * 900)], "doc_id bigint, text string")).first()
    assert [(d.start, d.stop) for d in x.detections] == [(3 * k, 3 * k + 2) for k in range(900)]


def test_detections_against_every_pair(spark):
    rng = random.Random(6)
    pool = ["licensed under the", "mit license", "apache license version 2 0", "gnu lesser general public license v2 1", "all rights reserved", "cc by sa 4 0", "bsd 3 clause license", "spdx license identifier mit", "word", "copyright 2020", "public domain"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(12))) for k in range(60)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    rules = licenses.rules()
    for k, t in rows:
        w = f" {t} "
        found = []
        for r in rules:
            if any(f" {x} " in w for x in r["keywords"]):
                found += [(w[: m.start()].count(" ") - 1, w[: m.end()].count(" "), r["priority"], r["rank"], r["label"]) for m in re.finditer(r["pattern"], w)]
        found.sort(key=lambda x: (x[0], -x[1], x[2], x[3]))
        stand = [x for i, x in enumerate(found) if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] for y in found[:i])]
        assert [(d.start, d.stop, d.priority, d.rank, d.label) for d in got[k].detections] == stand


def test_rules_of_the_caller_have_no_other_gate(spark):
    rule = {"label": "acme", "keyword": "acme", "pattern": "(?<= )acme terms apply(?= )", "priority": 1, "score": 0.8, "rank": 10_000}
    row = licenses.scan_licenses(spark.createDataFrame([(1, "The ACME terms apply.")], "doc_id bigint, text string"), [rule]).first()
    assert row.labels == "acme"


def test_mixing_against_a_plain_schedule(spark):
    rng = random.Random(2)
    sizes = {"a": 130, "b": 57, "c": 9, "d": 300, "": 12}
    rows = spark.createDataFrame([(k, s or None) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id bigint, source string")
    got = mixing.mix_sources(rows, weights={"a": 0.5, "b": 0.2, "d": 0.3}, block_rows=4, quanta=20, bin_rows=10).collect()
    k = {s: max(1, round(20 * w)) for s, w in {"a": 0.5, "b": 0.2, "c": 0.0, "d": 0.3, "": 0.0}.items()}
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    lasts = {s: -(-blocks[s] // k[s]) for s in sizes}
    slot, place, since = 0, {}, 0
    for until in sorted(set(lasts.values())):
        active = sorted(s for s in sizes if lasts[s] > since)
        h = sum(k[s] for s in active)
        for period in range(since, until):
            done = dict.fromkeys(active, 0)
            for t in range(h):
                ready = [(((done[s] + 1) * h + k[s] - 1) // k[s], i, s) for i, s in enumerate(active) if done[s] < k[s] and done[s] * h // k[s] <= t]
                s = min(ready)[2]
                place[s, period * k[s] + done[s]] = slot
                done[s] += 1
                slot += 1
        since = until
    assert {(r.source or "", r.block): r.slot for r in got} == {x: t for x, t in place.items() if x[1] < blocks[x[0]]}
    many = spark.createDataFrame([(k, f"host{k % 300}") for k in range(900)], "doc_id bigint, source string")
    wide = mixing.mix_sources(many, block_rows=1, quanta=300)
    assert wide.select("position").distinct().count() == 900 and wide.where("slot < release OR slot >= deadline").count() == 0
    assert rng is not None


def test_log_likelihood_ratio_against_plain_counts(spark, docs, marks):
    got = {r.doc_id: r for r in quality.score_quality(docs, marks, buckets=64).collect()}
    h = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = {r.doc_id: [h(w) for w in split(r.text)] for r in docs.collect()}
    grams = {k: [signed(x) % 64 for x in w] + [signed(pair(a, b)) % 64 for a, b in zip(w, w[1:], strict=False)] for k, w in rows.items()}
    good = {r.doc_id for r in marks.collect() if r.quality}
    raw, target = [0] * 64, [0] * 64
    for k, g in grams.items():
        for x in g:
            raw[x] += 1
            target[x] += k in good
    ratio = [round(math.log((t + 1) / (sum(target) + 64)) - math.log((r + 1) / (sum(raw) + 64)), 6) for r, t in zip(raw, target, strict=True)]
    for k, g in grams.items():
        llr = sum(ratio[x] for x in g) / len(g) if g else 0.0
        assert got[k].llr == pytest.approx(llr, abs=1e-8)
        assert got[k].kept == (not got[k].base_failed and got[k].llr >= quality.THRESHOLD)


def test_folds_hold_for_any_ids(spark):
    """Ids that are all multiples of the number of folds still leave rows out of each fold."""
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(0, 480, 3):
        bad = k % 4 == 0
        rows.append((k, sentence(rng, 40) + (" you idiot scum" if bad else ""), "en", "s", 1))
        marks.append((k, 1, int(bad)))
    frame, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    assert toxicity.sample(frame, labels, 1000).select("fold").distinct().count() == toxicity.FOLDS
    assert {r.doc_id for r in toxicity.score_toxicity(frame, labels).where("toxic").collect()} == {k for k, _, b in marks if b}


def test_held_out_accuracy_of_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    if not Path(folder).is_dir():
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0").groupBy("doc_id").agg(F.max("toxic").alias("truth"))
    rows = toxicity.score_toxicity(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), train).join(test, "doc_id").collect()
    bad, good = [r for r in rows if r.truth], [r for r in rows if not r.truth]
    assert sum(r.toxic for r in bad) >= 0.9 * len(bad) and sum(r.toxic for r in good) <= 0.03 * len(good) and len(bad) > 20


def test_every_operator_on_an_empty_table(spark, marks):
    none = spark.createDataFrame([], DOCS)
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    from lemmaflow.llm import mainhtml

    for out in (exactspans.drop_repeated_spans(none), neardup.keep_one(none), decontaminate.drop_leaks(none, benchmark), secrets.redact(none), mixing.mix_sources(none), toxicity.drop_toxic(none, none, marks), quality.score_quality(none, marks), licenses.scan_licenses(none), suffixtree.score_texts(none)):
        assert out.count() == 0
    assert mainhtml.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    base = [sentence(rng, 80) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1), (101, base[1] + " x", "en", "s1", 1), (102, "intro words " + base[2] + " and " + base[3][:300], "en", "s0", 1), (103, base[4] + " you idiot scum", "en", "s0", 1)]
    rows += [(104, sentence(rng, 60) + " token=abcdef99 end", "en", "s1", 1), (105, None, "en", None, None), (106, "", "en", "s1", 0), (None, "no id here", "en", "s1", 1)]
    leak = " ".join(f"q{k}z" for k in range(24))
    rows.append((107, sentence(rng, 30) + " " + leak + " " + sentence(rng, 30), "en", "s1", 1))
    bad = [(200 + k, sentence(rng, 50) + " what an idiot and scum", "en", "s0", 1) for k in range(12)]
    rows += bad
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 200)) for k, *_ in rows if k is not None and (k < 30 or k >= 200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    toxic = {k for k, t, *_ in rows if t and "idiot" in t}
    copies = {100, 101}
    expected = {(k, t.replace("token=abcdef99", "[secret]") if t else t) for k, t, *_ in rows if k not in toxic | copies | {107}}
    assert {(r.doc_id, r.text) for r in got} == expected and len(got) == len(expected)
    assert sorted(r.position for r in got) == sorted({r.position for r in got})
    assert next(r.n_chars for r in got if r.doc_id == 104) == len(next(r.text for r in got if r.doc_id == 104))
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_plain_helpers():
    assert exact_spans([(1, "a" * 150)])[1][1] == 149 and LOWER["A"] == "a" and json.loads("{}") == {}
