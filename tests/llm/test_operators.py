"""Each operator against a brute-force version on small fixtures, with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lemmaflow.llm import decontaminate, exactspans, licenses, mainhtml, mixing, neardup, quality, secrets, suffixtree, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta the of and to in over under light stone river cloud machine paper window green seven".split()
LOWER = {chr(c): chr(c + 32) for c in range(65, 91)}


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "x1"]) for _ in range(n))


def texts(seed=3, n=60):
    rng = random.Random(seed)
    out = [sentence(rng, rng.randrange(20, 160)) for _ in range(n)]
    out[5] = out[4]
    out[7] = out[6] + " more words at the end"
    out[9] = out[8] + "\n" + out[8] + "\n" + out[8]
    out[11] = out[10][:300] + sentence(rng, 30)
    return [*out, "", None, "   \n\t", "Short one", "é ü ß 日本 " * 30, "a" * 350, "x y z " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{0 if k % 3 == 0 else k % 5}", len(t or "")) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(LOWER.get(c, c) for c in t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def exact_spans(rows):
    seen, out = set(), {}
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_exact_spans(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(exactspans, "HOT_RECORDS", hot)
    monkeypatch.setattr(exactspans, "SHARD_RECORDS", 10 * hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exactspans.drop_repeated_spans(docs, busy=hot).collect()}
    assert got == exact_spans([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])


def test_exact_spans_of_repeated_and_missing_rows(spark, empty):
    assert exactspans.drop_repeated_spans(empty).count() == 0
    t = "repeat me " * 15
    rows = spark.createDataFrame([(1, t[:110] + "a" * 99), (1, t[:110] + "a" * 99), (None, t[:105])], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in exactspans.drop_repeated_spans(rows).collect())
    expected = exact_spans([(-1, t[:105]), (1, t[:110] + "a" * 99)])
    assert got == [(-1, expected[-1][1]), (1, expected[1][1]), (1, expected[1][1])]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        text = rng.integers(0, 3, n).astype(np.uint8)
        order, place = exactspans.suffix_array(text)
        suffixes = sorted(range(n), key=lambda k: text[k:].tobytes())
        assert order.tolist() == suffixes
        shared = exactspans.common_prefixes(text, order, place, np.array([0]), np.array([n]), 100)
        for k in range(1, n):
            a, b = text[order[k - 1] :].tobytes(), text[order[k] :].tobytes()
            true = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert shared[order[k]] == min(true, 100)


def test_spread_windows_are_merged_without_a_pass_over_all_for_each_shard():
    rng = np.random.default_rng(2)
    rows = {(k, s): d for k, s, d in rng.integers(0, (4_000, 2_000, 20), (60_000, 3)).tolist()}
    one, shard, doc = (np.array(x) for x in zip(*((*k, d) for k, d in rows.items()), strict=True))
    first = {}
    for k, d in zip(one.tolist(), doc.tolist(), strict=True):
        first[k] = min(d, first.get(k, d))
    began = time.process_time()
    got = exactspans.merged_repeats(pa.table({"one": one // 2, "two": one, "doc": doc, "start": one % 7, "shard": shard})).to_pydict()
    other = np.arange(40_000)
    none = exactspans.merged_repeats(pa.table({"one": rng.permutation(other), "two": other, "doc": other, "start": other, "shard": other % 2_000}))
    assert time.process_time() - began < 10
    assert set(zip(got["doc"], got["start"], strict=True)) == {(d, k % 7) for k, d in zip(one.tolist(), doc.tolist(), strict=True) if d > first[k]}
    assert none.num_rows == 0


def test_main_text(spark):
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p>One <b>two</b><br>three&nbsp;four</p><ul><li>a<li>b</ul><div class='comments'>c</div><form>f</form></article><footer>f</footer></body></html>"
    other = page.replace("One", "Other one that is longer than before")
    rows = [(1, "http://h.x/a", page), (2, "http://h.x/b", other), (3, "http://h.x/c", "<p>loose text</p>"), (4, None, None), (5, "http://h.x/d", ""), (5, "http://h.x/d", "<nav>menu</nav>")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in mainhtml.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got[0] == (1, "T & x\nOne two three four\na\nb", len("T & x\nOne two three four\na\nb"))
    assert got[2] == (3, "loose text", 10) and got[3] == (4, "", 0) and got[4] == (5, "", 0) and got[5] == (5, "", 0)
    assert html.unescape("&amp;") == "&"


def test_main_text_keeps_the_whole_article(spark):
    """Title, lead and closing words outside the article's body, and a page whose template differs from its host's."""
    body = " ".join(["words of the body"] * 120)
    nested = f"<body><article><h1>Title</h1><p>lead</p><div class='body'><p>{body}</p></div><p>end</p></article><div>after</div></body>"
    plain = f"<body><div class='page'><h1>Title</h1><div class='body'><p>{body}</p></div><p>end</p></div></body>"
    other = f"<body><main><h2>Other</h2><div><p>{body}</p></div></main><article><p>{body[:700]}</p></article></body>"
    rows = [(1, "http://a.x/1", nested), (2, "http://a.x/2", nested), (3, "http://a.x/3", other), (4, "http://b.x/1", plain)]
    got = {r.page_id: r.text for r in mainhtml.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == f"Title\nlead\n{body}\nend"
    assert got[3] == f"Other\n{body}\n{body[:700].strip()}" and got[4] == f"Title\n{body}\nend"


def test_main_text_inside_what_looks_like_noise():
    """Wrappers of the whole page are no noise, and an unclosed embedded object ends nothing."""
    story = " ".join(["words of the story"] * 40)
    article, plain = f"<article><p>{story}</p></article>", f"<div><p>{story}</p></div>"
    for start in ("<form>", "<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<div class='with-comments'>", "<div class='page-overlay'>", "<canvas>", "<iframe src=x>", "<object>", "<svg>"):
        for inner in (article, article.replace("article", "main"), plain):
            page = mainhtml.Page(f"<body><nav>menu</nav>{start}{inner}<div class='comments'>a reply</div><button>go</button></body>")
            assert page.along(set()) == story, (start, inner)
    for page in (f"<div class='comments'><article>{story}</article></div><article>short</article>", f"<div class='comments'>{story}</div><article>short</article>", "<article>short</article><form>f</form>"):
        assert mainhtml.Page(page).along(set()) == "short"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(160):
        t = sentence(rng, 60)
        bad = k % 4 == 0
        if bad:
            w = t.split()
            for x in rng.sample(["idiot", "scum", "trash", "moron"], 2):
                w.insert(rng.randrange(len(w)), x)
            t = " ".join(w)
        rows.append((k, t, "en", "s", len(t)))
        marks.append((k, 1, int(bad)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "you idiot scum", "en", "s", 3)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), {k for k, _, b in marks if b}


def test_toxicity(spark, labelled, empty):
    rows, marks, bad = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(rows, marks).collect()}
    assert {k for k, r in got.items() if r.toxic} == bad | {902}
    assert got[900].p_toxic == got[901].p_toxic
    assert got[902].p_insult > 0.5 > got[1].p_insult
    none = toxicity.score_toxicity(rows, marks.where("toxic = 0"))
    assert none.where("toxic").count() == 0 and none.count() == rows.count()
    assert toxicity.score_toxicity(empty, marks).count() == 0
    kept = toxicity.drop_toxic(rows, rows, marks)
    assert kept.columns == rows.columns and kept.count() == rows.count() - len(bad) - 1


def test_a_labelled_id_trains_with_one_text_however_often_it_occurs(spark):
    rows = spark.createDataFrame([(1, "beta word", "en", "s", 9)] * 40 + [(1, "alpha word", "en", "s", 10), (1, None, "en", "s", 0), (2, None, "en", "s", 0), (3, "no label", "en", "s", 8)], SCHEMA)
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: (r.toxic, sorted(r.features)) for r in toxicity.sample(rows, marks, 10).collect()}
    assert got == {1: (1, ["alpha", "word"]), 2: (0, [])} and toxicity.sample(rows, marks, 10).count() == 2


def test_quality_counts(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    for r in docs.collect():
        w = split(r.text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if split(x)]
        g = got[r.doc_id]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(repeated))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == expected
        assert g.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (g.kept and g.base_failed)
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(docs, labels.where("false")).where("llr <> 0").count() == 0


def test_quality_ratio_prefers_the_target(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng, 80) if k % 2 else " ".join(f"##{rng.randrange(999)}" for _ in range(80)), "en", "s", 1) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.llr for r in quality.score_quality(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert min(v for k, v in got.items() if k % 2) > quality.THRESHOLD > max(v for k, v in got.items() if not k % 2)


def test_benchmark_leaks(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [" ".join(word() for _ in range(n)) for n in (15, 30, 60)]
    clean = [" ".join(word() for _ in range(120)) for _ in range(30)]
    cut = item[2].split()
    for k in range(3, 60, 9):
        cut[k] = word()
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100, clean[0] + "\n" + item[0].upper() + " " + clean[1]), (101, clean[2] + " " + item[1] + " " + clean[3]), (102, " ".join(cut)), (103, item[2]), (103, item[2]), (104, None), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(0, item[0]), (1, item[1]), (2, item[2]), (3, ""), (4, None)], "item_id bigint, text string")
    found = decontaminate.benchmark_leaks(docs, benchmark, rank=32)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(100, 0), (101, 1), (102, 2), (103, 2), (103, 2)]
    again = decontaminate.benchmark_leaks(docs, benchmark, rank=32, block_words=20)
    assert sorted((r.doc_id, r.item_id) for r in again.collect()) == sorted((r.doc_id, r.item_id) for r in found.collect())
    assert decontaminate.drop_leaks(docs, benchmark).count() == len(rows) - 5
    assert decontaminate.benchmark_leaks(docs, benchmark.where("item_id > 2")).count() == 0
    assert decontaminate.benchmark_leaks(empty, benchmark).count() == 0


def test_short_items_are_found_verbatim_at_every_alignment(spark):
    """Items of 2 to 16 words, copied whole among rarer words that outweigh them."""
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate([2, 3, 4, 5, 6, 8, 10, 12, 14, 16] * 30)]
    rows, planted = [(k, sentence(rng, 60), "en", "s", 0) for k in range(10**4, 10**4 + 100)], set()
    for k, (item, text) in enumerate(items):
        rare = [f"r{k}x{j}" for j in range(80)]
        at = k % 33
        rows.append((k, " ".join(rare[:at] + text.split() + rare[at:]), "en", "s", 0))
        planted.add((k, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert not planted - got


def test_leaks_against_a_search_through_every_place(spark):
    """Every document and item of the smallest tables by the plain subsequence at every passage: at least 0.9 are found, and nothing else."""
    folder = "/root/testdata/sf0.001"
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    true = set()
    items = [(r.item_id, split(lowered(r.text))) for r in benchmark.collect()]
    for r in docs.collect():
        w = split(lowered(r.text))
        for item, x in items:
            n, masks = len(x), decontaminate.masks_of(x)
            tail = x[-max(3, n // 4) :]
            for k in range(0, len(w), 16) if n else ():
                window = w[max(0, k - n) : k + 32 + n]
                if sum(map(masks.__contains__, window)) >= 0.6 * n:
                    lcs = decontaminate.common_subsequence(masks, n, window) / n
                    if lcs >= 0.8 or (lcs >= 0.6 and decontaminate.common_subsequence(decontaminate.masks_of(tail), len(tail), window) / len(tail) >= 0.5):
                        true.add((r.doc_id, item))
                        break
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(docs, benchmark).collect()}
    assert got <= true and len(got & true) >= 0.9 * len(true) > 0


def test_common_subsequence():
    rng = random.Random(7)
    for _ in range(50):
        a, b = [rng.randrange(4) for _ in range(12)], [rng.randrange(4) for _ in range(20)]
        best = [[0] * 21 for _ in range(13)]
        for i in range(12):
            for j in range(20):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.masks_of(a), 12, b) == best[12][20]


def test_mixing(spark, docs, empty):
    n = 3000
    rows = spark.createDataFrame([(k, "s0" if k % 2 else f"s{k % 7}") for k in range(n)] + [(None, None), (5, "s0"), (5, "s0")], "doc_id bigint, source string")
    got = mixing.mix_sources(rows, block_rows=10, quanta=50, bin_rows=100).collect()
    assert len(got) == n + 3 and len({r.position for r in got}) == n + 3
    assert all(r.release <= r.slot < r.deadline for r in got)
    blocks = {(r.source or "", r.block): r.slot for r in got}
    count = collections.Counter(r.source or "" for r in got)
    total = sum(math.sqrt(v) for v in count.values())
    k = {s: max(1, round(50 * math.sqrt(v) / total)) for s, v in count.items()}
    first_end = min(max(t for (s, _), t in blocks.items() if s == x) for x in k)
    for s in k:
        at = sorted(t for (x, _), t in blocks.items() if x == s and t <= first_end)
        assert all(abs(j + 1 - k[s] / sum(k.values()) * (t + 1)) < 1 for j, t in enumerate(at))
    weighted = mixing.mix_sources(rows.where("source IN ('s0', 's2')"), weights={"s0": 0.25, "s2": 0.75}, block_rows=10).collect()
    early = [r for r in weighted if r.slot < 20]
    assert abs(sum(r.source == "s2" for r in early) - 150) <= 10
    assert mixing.mix_sources(empty.select("doc_id", "source")).count() == 0
    full = mixing.mix_sources(docs)
    assert full.count() == docs.count() and full.columns[:5] == docs.columns


def test_near_duplicates(spark, empty):
    rng = random.Random(9)
    base = [sentence(rng, 100) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[0]) for k in range(5)] + [(200 + k, " ".join(base[1].split()[:-1] + [f"w{k}"])) for k in range(8)]
    half = base[2].split()
    rows += [(300, " ".join(half[:60] + sentence(rng, 40).split())), (301, None), (302, ""), (303, " \n"), (304, "Hi there"), (305, "hi  there"), (306, "x y z " * 200), (307, "x y z " * 190), (3, base[3]), (None, base[4])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    bags = {}
    for k, t in rows:
        w = split(lowered(t))
        bags[k] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None
    parent = {k: k for k in bags if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in parent if bags[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if 5 * both >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {(r.doc_id, r.class_id) for r in got} == {(k, root(k)) for k in parent} | {(None, None)}
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    kept = neardup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({root(k) for k in parent})
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_bucket_of_unlike_texts(spark, monkeypatch):
    """Hundreds of texts of one template, all under 0.8, and one pair that ranks last, in one bucket."""
    buckets = neardup.crowded_buckets
    monkeypatch.setattr(neardup, "crowded_buckets", lambda reps: buckets(reps.selectExpr("digest", "doc_id", "mass", "array(0L) AS bands")))
    shared = [f"t{j}" for j in range(75)]
    rows = [(k, " ".join(shared + [f"u{k}x{j}" for j in range(25)])) for k in range(300)]
    rows += [(1000 + k, " ".join(shared + [f"p{j}" for j in range(23)] + [f"q{k}", f"r{k}"])) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    bags = {k: {tuple(t.split()[j : j + 5]) for j in range(96)} for k, t in rows}
    similar = {(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) * 5 >= len(bags[a] | bags[b]) * 4}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame).collect()}
    assert {(a, b) for a in got for b in got if a < b and got[a] == got[b]} == similar == {(1000, 1001)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 52, 400).astype(np.uint64)
    x, y = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    hashes, rows = np.concatenate([h[x > 0], h[y > 0]]), np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    got = neardup.bag_minhash(hashes, rows, np.concatenate([x[x > 0], y[y > 0]]), 2, 4096)
    assert np.isfinite(got).all() and abs((got[0] == got[1]).mean() - true) < 0.03


def plain_tree_scores(texts, held, min_count, depth=5, weight=8.0):
    """log10 probability of each text by a suffix tree made the plain way, with dictionaries of byte strings."""
    streams = {k: (b" ".join(x.encode() for x in split(lowered(t))) or b"") + b"\xff" for k, t in texts.items()}
    follows = collections.defaultdict(collections.Counter)
    for k, x in streams.items():
        if not held[k]:
            y = b"\xff" * depth + x
            for j in range(depth, len(y)):
                for d in range(depth + 1):
                    follows[y[j - d : j]][y[j]] += 1
    kept = set()
    for c, n in follows.items():
        total, above = sum(n.values()), follows[c[1:]]
        gain = sum(v * math.log(v * sum(above.values()) / (total * above[s])) for s, v in n.items()) if c else 0
        if c and total >= min_count and gain > 0.5 * len(n) * math.log(total):
            kept |= {c[j:] for j in range(len(c) + 1)}

    def price(c, s):
        longest = next((c[j:] for j in range(len(c)) if c[j:] in kept), b"")
        p = 1 / 256
        for d in range(len(longest) + 1):
            n = follows.get(longest[len(longest) - d :], {})
            p = (n.get(s, 0) + weight * p) / (sum(n.values()) + weight)
        return math.log10(p)

    padded = {k: b"\xff" * depth + x for k, x in streams.items()}
    return {k: sum(price(y[j - depth : j], y[j]) for j in range(depth, len(y))) for k, y in padded.items()}, kept


@pytest.mark.parametrize("bucket", [1 << 25, 500])
def test_suffix_tree(spark, docs, empty, bucket):
    got = {r.doc_id: r for r in suffixtree.score_texts(docs, min_count=5, bucket_bytes=bucket).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {k: [*split(lowered(t)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in words}
    c = collections.Counter(x for k, w in words.items() if not held[k] for x in w)
    n, v = sum(c.values()), len(c)
    scores, kept = plain_tree_scores(texts, held, 5)
    assert len(kept) > 100 and max(map(len, kept)) == 5
    for k, w in words.items():
        g = got[k]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[k], len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert g.score == pytest.approx(scores[k], rel=1e-9)
    assert suffixtree.score_texts(empty).count() == 0


def test_suffix_tree_learns(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["abab", "cdcd"]) for _ in range(60))) for k in range(100)]
    strange = next(k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows.append((strange, "zqzx wvkj pfgh " * 20))
    got = {r.doc_id: r for r in suffixtree.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    per = {k: r.score / r.n_tokens for k, r in got.items()}
    usual = [v for k, v in per.items() if k != strange]
    assert -0.4 < min(usual) and max(usual) < -0.25 and per[strange] < -3


def test_licenses(spark, docs, empty):
    text = "CC BY cc-by, All rights reserved; SPDX-License-Identifier: MIT licensed under the terms of the Apache License, Version 2.0"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "cc by cc byİ K general public license"), (5, text)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    for k, r in got.items():
        t = {1: text, 5: text, 4: "cc by cc byİ K general public license"}.get(k, "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        at = sorted(j for p in licenses.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
    assert got[1].labels == "apache-2.0,cc-by,mit,reserved" and got[1].score == 1.0 and got[1].base_labels == "cc-by,reserved"
    assert got[2].labels == "" and got[2].score == 0.0 and got[4].labels == "cc-by,gpl"
    for a in got[1].detections:
        assert not any(b is not a and b.start <= a.start and a.stop <= b.stop and b.priority <= a.priority for b in got[1].detections)
    assert len(licenses.rules()) > 200 and licenses.scan_licenses(empty).count() == 0


def spellings(pattern):
    """Every alternative of a pattern, with optional parts absent and present; a range gives its first character."""

    def expand(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN":
                more = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg]
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in expand(branch)]
            elif name == "ANY":
                more = ["x"]
            elif name == "SUBPATTERN":
                more = expand(arg[3])
            else:
                assert name == "MAX_REPEAT"
                more = [x * n for n in {arg[0], max(arg[0], 1)} for x in expand(arg[2])]
            out = [x + y for x in out for y in more]
        return out

    return sorted(set(expand(re._parser.parse(pattern))))


def test_every_alternative_of_every_license_rule_passes_the_gates(spark):
    names = [(label, x) for label, _, p in licenses.NAMES for x in spellings(p)] + [(label, x) for label, _, p, _ in licenses.NOTICES for x in spellings(p)]
    names += [(label, f"{grant} the terms of the {x}") for label, x in names for grant in ("licensed under",) if x in ("freebsd license", "0bsd", "psf license", "gnu library general public license")]
    rows = spark.createDataFrame(list(enumerate(x for _, x in names)), "doc_id bigint, text string")
    got = {r.doc_id: [d for d in r.detections if d.start == 0 and d.stop == r.n_words] for r in licenses.scan_licenses(rows).collect()}
    assert not [x for k, (label, x) in enumerate(names) if label not in [d.label for d in got[k]]]


BASE = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def test_secrets(spark, docs, empty):
    key = "AKIA" + "B" * 16
    special = ["password: token: abcdefg", f"é {key} " + "ab" * 14, "token = x", 'Secret="ab=cdefgh"', "user: bob\nhttps://a.b/c\n\nclient_id=zzz", "https://lonely.example/x", "日 passwd=" + "9f" * 20, None, ""]
    rows = spark.createDataFrame(list(enumerate(special)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(rows).collect()}
    for k, t in enumerate(special):
        found = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m))
        listed = ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in found)
        g = got[k]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(i == j for _, i, _ in found) for j in range(3))
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(g.spans.split(","))
    assert got[4].spans == "id:0:9,endpoint:10:23" and got[5].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(rows.selectExpr("doc_id", "text", "'x' AS found")).collect()}
    assert clean[6] == "日 [secret]" and clean[7] is None and clean[5] == special[5] and key not in clean[1]
    assert secrets.scan_secrets(empty).count() == 0
