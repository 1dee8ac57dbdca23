import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lemmaflow.plans.components import connected_components
from lemmaflow.plans import fixpoint
from lemmaflow.plans.fixpoint import closure_pairs, label_counts, labels_reaching, reachable, reaching, spread
from lemmaflow.plans.scratch import Buckets


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(df):
    return {r[0] for r in df.collect()}


def search(pairs, targets):
    """Nodes that lead to a target, by a plain search backwards."""
    found, todo = set(targets), list(targets)
    while todo:
        v = todo.pop()
        for a, b in pairs:
            if b == v and a not in found:
                found.add(a)
                todo.append(a)
    return found


def test_who_reaches_the_targets(spark):
    rng = random.Random(21)
    for size, many, aims in ((30, 25, 2), (60, 90, 1), (12, 60, 3)):
        pairs = [(str(rng.randrange(size)), str(rng.randrange(size))) for _ in range(many)]
        targets = [str(rng.randrange(size)) for _ in range(aims)]
        assert ids(reaching(edges(spark, pairs), spark.createDataFrame([(t,) for t in targets], "id string"))) == search(pairs, targets)


@pytest.mark.parametrize(("hops", "few", "bucket", "hub"), [(1, 1000, 1 << 16, 1000), (2, 1000, 4, 1000), (5, 3, 8, 1000), (3, 1000, 4, 3)])
def test_any_number_of_hops_buckets_and_hubs_gives_the_same(spark, monkeypatch, hops, few, bucket, hub):
    for name, value in (("HOPS", hops), ("FEW_ROWS", few), ("EDGES_PER_BUCKET", bucket), ("LEAST_HUB", hub), ("HUB_SHARE", 1)):
        monkeypatch.setattr(fixpoint, name, value)
    pairs = [(str(k), str(k + 1)) for k in range(20)] + [("7", "2"), ("30", "31"), ("31", "30"), ("31", "5"), ("4", "4"), (None, "9"), ("3", None)] + [(f"h{k}", "9") for k in range(20)] + [("h1", "h2"), ("x", "h7")]
    facts = spark.createDataFrame([("9", 0, 1), ("9", 0, 4), ("9", 3, -1 << 63), ("2", 0, 2), (None, 0, 1)], "id string, word bigint, bits bigint")
    got = spread(edges(spark, pairs), facts).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")).collect()
    nine, two = (search([p for p in pairs if None not in p], [t]) for t in ("9", "2"))
    assert {(r.id, r.word): r.bits for r in got} == {(v, 0): 5 * (v in nine) + 2 * (v in two) for v in nine | two} | {(v, 3): -1 << 63 for v in nine}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("lemmaflow_edges", "lemmaflow_facts"))]


def test_ids_of_different_types_lie_in_the_same_buckets(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "EDGES_PER_BUCKET", 40)
    files = []
    add = Buckets.add
    monkeypatch.setattr(Buckets, "add", lambda self, df, table, **m: (add(self, df, table, **m), files.append((self.buckets, len(list(Path(table[1].removeprefix("file:")).glob("*.parquet"))))))[0])
    start = spark.sql("SELECT 0 AS id, 0L AS word, 1L AS bits")
    far = 1 << 40
    tree = spark.range(1, 200).selectExpr("id AS src", "id div 2 AS dst").union(spark.range(1, 200).selectExpr(f"id + {far} AS src", "id AS dst"))
    assert ids(spread(tree, start)) == {0, *range(1, 200), *(k + far for k in range(1, 200))}
    buckets, rounds = files[0][0], len(files) - 1
    assert buckets > 1 and files[-1][1] <= buckets * rounds


def test_a_round_exchanges_its_new_facts_alone(spark):
    own = fixpoint.walker(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with Buckets(own, 2) as at:
        back, facts = at.table("edges"), at.table("facts")
        at.add(own.range(50).selectExpr("id", "id + 1 AS src").repartition(2, "id"), back)
        at.add(own.range(5).selectExpr("id", "0L AS word", "1L AS bits", "1L AS fresh", "0 AS round").repartition(2, "id"), facts)
        plan = fixpoint.a_round(own.table(facts[0]), 0, own.table(back[0]), None, 2, 1)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan


def test_a_round_broadcasts_nothing(spark):
    own = fixpoint.walker(spark)
    with Buckets(own, 2) as at:
        back, facts = at.table("edges"), at.table("facts")
        at.add(own.range(50).selectExpr("id", "id + 1 AS src").repartition(2, "id"), back)
        at.add(own.range(5).selectExpr("id", "0L AS word", "1L AS bits", "1L AS fresh", "0 AS round").repartition(2, "id"), facts)
        assert "Broadcast" not in fixpoint.a_round(own.table(facts[0]), 0, own.table(back[0]), None, 2, 3)._jdf.queryExecution().executedPlan().toString()


def test_reachable_runs_forward(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    assert ids(reachable(e, spark.createDataFrame([("a",)], "id string"))) == set("abc")
    assert ids(reachable(e, spark.createDataFrame([], "id string"))) == set()


def test_random_graphs_agree_with_plain_search(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(70)]
        own = [(str(k), f"L{k % 4}") for k in range(0, 40, 7)]
        sets = {str(k): {l for n, l in own if n == str(k)} for k in range(40)}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                if not sets[b] <= sets[a]:
                    sets[a] |= sets[b]
                    changed = True
        got = labels_reaching(edges(spark, pairs), spark.createDataFrame(own, "id string, label string"))
        assert {(r.id, r.label) for r in got.collect()} == {(n, l) for n, ls in sets.items() for l in ls}


@pytest.mark.parametrize(("size", "many", "least"), [(40, 70, 1), (60, 75, 12)])
def test_labels_around_pivots_agree_with_plain_search(spark, monkeypatch, size, many, least):
    monkeypatch.setattr(fixpoint, "PIVOT_NODES", least)
    monkeypatch.setattr(fixpoint, "PIVOT_EDGES", 1)
    rng = random.Random(size + many)
    draw = lambda: rng.randrange(size) if rng.random() < 0.7 else size + rng.randrange(20)
    pairs = [(str(a), str(b)) for a, b in ((draw(), draw()) for _ in range(many)) if (a < size) == (b < size)] + [("x", "y"), ("y", "x"), ("3", "3")]
    own = [(str(k), f"L{k % 9}") for k in range(0, size + 20, 2)] + [("y", "Y"), ("alone", "L1"), ("0", None)]
    want = {(n, label) for v, label in own if label for n in search(pairs, [v])}
    start = spark.createDataFrame(own, "id string, label string")
    got = [tuple(r) for r in labels_reaching(edges(spark, pairs), start).select("id", "label").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = [str(k) for k in range(0, size, 3)] + ["alone", "x", "x"]
    counts = {r.label: r.n for r in label_counts(edges(spark, pairs), start, spark.createDataFrame([(k,) for k in some], "id string")).collect()}
    assert counts == {label: n for label in {x for _, x in want} if (n := sum((k, label) in want for k in set(some)))}


def test_what_passes_a_core_is_not_walked_pair_by_pair(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(fixpoint, "PIVOT_EDGES", 1_000, raising=False)
    monkeypatch.setattr(fixpoint, "spread", lambda e, s: walked.append(spread(e, s)) or walked[-1])
    n = 400
    pairs = [(k, (k + 1) % n) for k in range(n)] + [(k, (k * 7 + 3) % n) for k in range(n)]
    pairs += [(n + k, (k * 3) % n) for k in range(n)] + [(n + k, (k * 5) % n) for k in range(n)] + [((k * 11) % n, 2 * n + k) for k in range(n)]
    graph = spark.createDataFrame(pairs, "src bigint, dst bigint")
    own = spark.createDataFrame([(2 * n + k, k) for k in range(n)], "id bigint, label bigint")
    assert labels_reaching(graph, own).count() == 2 * n * n + n
    assert sum(w.count() for w in walked) < 8 * n


def test_a_long_chain_completes(spark):
    chain = [(str(k), str(k + 1)) for k in range(60)]
    assert len(ids(reaching(edges(spark, chain), spark.createDataFrame([("60",)], "id string")))) == 61


def test_a_chain_of_100000_completes(spark):
    chain = spark.range(100_000).selectExpr("id AS src", "id + 1 AS dst")
    assert reaching(chain, spark.createDataFrame([(100_000,)], "id bigint")).count() == 100_001
    own = spark.createDataFrame([(100_000, "end"), (40_000, "middle"), (40_000, "end")], "id bigint, label string")
    got = labels_reaching(chain, own).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"end": 100_001, "middle": 40_001}


def test_contraction_keeps_what_is_reached(spark):
    rng = random.Random(13)
    for size, many in ((60, 55), (40, 45), (25, 20)):
        pairs = [(str(rng.randrange(size)), str(rng.randrange(size))) for _ in range(many)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "d"), ("f", "0")]
        targets = ["0", "7", str(size - 1)]
        one = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
        rest, alias = fixpoint.contracted(edges(spark, pairs), one(targets))
        assert rest.count() < len(set(pairs)) and not ids(alias) & set(targets)
        assert {r[0] for r in rest.collect()}.isdisjoint(ids(alias))
        assert ids(reaching(edges(spark, pairs), one(targets))) == search(pairs, targets)


def test_closure_stops_at_emitted_nodes(spark):
    rng = random.Random(8)
    for _ in range(3):
        pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)]
        inner, stop = set(range(0, 30, 2)) | set(range(0, 30, 3)), set(range(1, 30, 2)) - set(range(0, 30, 3))
        want = set()
        for root in inner:
            seen, todo = {root}, [root]
            while todo:
                v = todo.pop()
                for a, b in pairs:
                    if a == v and b in stop:
                        want.add((str(root), str(b)))
                    if a == v and b in inner and b not in seen:
                        seen.add(b)
                        todo.append(b)
        one = lambda xs: spark.createDataFrame([(str(x),) for x in xs], "id string")
        got = closure_pairs(edges(spark, [(str(a), str(b)) for a, b in pairs]), one(inner), one(stop))
        assert {(r.src, r.dst) for r in got.collect()} == want


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (20, 30), (30, 20)], "a int, b int")
    assert {(r.id, r.label) for r in connected_components(e).collect()} == {(5, 1), (4, 1), (3, 1), (9, 1), (1, 1), (20, 20), (30, 20)}


def test_levels_of_a_recursive_query_are_merged(spark, monkeypatch):
    plans, write = [], fixpoint.written_with
    monkeypatch.setattr(fixpoint, "written_with", lambda df, *a, **k: plans.append(df._jdf.queryExecution().analyzed().toString()) or write(df, *a, **k))
    assert ids(reachable(edges(spark, [("a", "b"), ("b", "c")]), spark.createDataFrame([("a",)], "id string"))) == set("abc")
    assert "strategy=merge" in plans[0]
