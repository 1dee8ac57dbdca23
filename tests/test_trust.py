import random

import pytest

from lemmaflow.operators import graph as G
from lemmaflow.operators import trust as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        ({}, {"ax": "trusted", "ev": "trusted", "direct": "unverified", "via": "verified", "clean": "transitively-verified", "out": None}),
        ({"skip_enrich": True}, {"ax": "trusted", "ev": "trusted", "direct": "unverified", "via": "verified", "clean": "verified", "out": None}),
        ({"skip_verify": True}, {"ax": "trusted", "ev": "trusted", "direct": None, "via": None, "clean": None, "out": None}),
    ],
)
def test_status_matrix(spark, mode, expected):
    decl = frame(spark, [("ax", True), ("ev", True), ("direct", True), ("via", True), ("clean", True), ("out", False)], "id string, in_project boolean")
    trusted = frame(spark, [("ax", "axiom"), ("ev", "externally_verified")], "id string, reason string")
    taint, direct = frame(spark, [("direct",), ("via",)], "id string"), frame(spark, [("direct",)], "id string")
    got = {r.id: r for r in T.stamped(T.verdicts(decl, trusted, taint, direct), **mode).collect()}
    assert {k: r.status for k, r in got.items()} == expected
    assert got["ax"].reason == "axiom"
    assert got["via"].origin == (None if mode.get("skip_verify") else "kernel-taint")


def plain_sets(kind, edge, trusted, inside, standard, extra):
    """What each node rests on, by rounds over the whole graph until nothing changes."""
    quiet = {n for n in kind if n in standard and n not in inside}
    sets = {n: {n} if n == "sorryAx" or (kind[n] == "axiom" and n not in quiet) else set() for n in kind}
    while True:
        before = {n: set(s) for n, s in sets.items()}
        for a, b, role in edge:
            if a == "sorryAx" or a in quiet or (kind[a] == "axiom" and role == "value"):
                continue
            vouches = a in trusted and role == "value"
            sets[a] |= {a if vouches and x == "sorryAx" else x for x in sets[b]}
        for a, b in extra:
            if a != "sorryAx":
                sets[a] |= sets[b]
        if sets == before:
            return sets


@pytest.mark.parametrize("seed", range(4))
def test_assumption_sets(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(40)]
    kind = {n: rng.choice(["def", "def", "thm", "axiom"]) if k % 5 == 0 else "def" for k, n in enumerate(names)} | {"sorryAx": "axiom"}
    inside = {n for k, n in enumerate(names) if k % 7 != 6}
    trusted = {n for n in inside if rng.random() < 0.25}
    standard = [n for n in names if kind[n] == "axiom"][:2]
    edge = [(rng.choice(names), rng.choice(names), rng.choice(["type", "value"])) for _ in range(75)]
    edge += [(n, "sorryAx", rng.choice(["type", "value"])) for n in rng.sample(names, 5)]
    extra = [(rng.choice(names), rng.choice([*names, "sorryAx"])) for _ in range(4)]
    d = frame(spark, [(n, k, n in inside) for n, k in kind.items()], "id string, kind string, in_project boolean")
    pairs = T.assumption_pairs(d, frame(spark, edge, "src string, dst string, role string"), frame(spark, [(n, "external") for n in trusted], "id string, reason string"), "sorryAx", standard, extra=frame(spark, extra, "src string, dst string"))
    got = {n: set() for n in kind}
    for r in pairs.collect():
        got[r.id].add(r.label)
    quiet = {n for n in standard if n not in inside}
    want = plain_sets(kind, edge, trusted, inside, standard, [(a, b) for a, b in extra])
    assert {n: s for n, s in got.items() if n not in quiet} == {n: s for n, s in want.items() if n not in quiet}


def test_merges(spark):
    rows = [("m", "P.A", True), ("m", "P.B", True), ("x", "P.R", True), ("x", "Dep", False), ("one", "P.A", True)]
    got = {r.name: (r["class"], r.modules) for r in G.merge_classes(frame(spark, rows, "name string, module string, in_project boolean")).collect()}
    assert got == {"m": ("merged", ["P.A", "P.B"]), "x": ("cross", ["P.R"])}


def test_ownership(spark):
    owner = frame(spark, [("a", "l", None), ("b", None, "e"), ("c", None, "e"), ("d", "l", "e"), ("f", None, None), ("g", None, "e")], "module string, lib string, exe string")
    one = lambda *n: frame(spark, [(x,) for x in n], "module string")
    got = {r.module: r.verdict for r in G.ownership(owner, one("c"), one("b")).collect()}
    assert got == {"a": "ok", "b": "ok", "c": "exeImported", "d": "libAndExe", "f": "unowned", "g": "internal"}


def test_import_closure_stays_in_the_build_folder(spark):
    module = frame(spark, [("A", True), ("B", True), ("C", True), ("Dep", False)], "module string, in_build_dir boolean")
    imports = frame(spark, [("A", "Dep"), ("A", "C"), ("B", "C"), ("C", "Dep")], "module string, imported string")
    got = G.import_closure(module, imports, frame(spark, [("A",), ("B",)], "module string"))
    assert {r.module for r in got.collect()} == {"A", "B", "C"}


def test_folded_edges_skip_the_host(spark):
    edge = frame(spark, [("H1", "aux"), ("H2", "aux"), ("aux", "H1"), ("aux", "L")], "src string, dst string")
    closure = G.fold_closure(edge, frame(spark, [("aux",)], "id string"), frame(spark, [("H1",), ("H2",), ("L",)], "id string"))
    got = G.folded_edges(edge, closure, frame(spark, [("H1",), ("H2",)], "id string"))
    assert {(r.src, r.dst) for r in got.collect()} == {("H1", "L"), ("H2", "H1"), ("H2", "L")}


def test_labels_in_use_and_their_holders_agree_with_the_pairs(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(40)]
    inside = {n for k, n in enumerate(names) if k % 3}
    trusted = [n for n in sorted(inside) if rng.random() < 0.25]
    d = frame(spark, [(n, "axiom" if k % 4 == 0 else "def", n in inside) for k, n in enumerate(names)] + [("s", "axiom", False)], "id string, kind string, in_project boolean")
    edge = frame(spark, [(rng.choice(names), rng.choice([*names, "s"]), rng.choice(["type", "value"])) for _ in range(60)] + [("n1", "s", "value")], "src string, dst string, role string")
    given = (d, edge, frame(spark, [(n, "external") for n in trusted], "id string, reason string"), "s", ["n0", "n4"])
    want = {}
    for r in T.assumption_pairs(*given).collect():
        want[r.label] = want.get(r.label, 0) + (r.id in inside)
    want = {label: n for label, n in want.items() if n}
    assert {r.label: r.n for r in T.assumption_holders(*given).collect()} == want
    for each in ("labels_reaching", "label_counts"):
        monkeypatch.setattr(T, each, None)
    used = [r.label for r in T.labels_in_use(*given).collect()]
    assert sorted(used) == sorted(want)


def test_sides_that_grow_are_not_broadcast(spark):
    d = frame(spark, [("a", True), ("b", True)], "id string, in_project boolean")
    edge, trusted = frame(spark, [("a", "b", "value")], "src string, dst string, role string"), frame(spark, [("b", "axiom")], "id string, reason string")
    for df in (T.walk_edges(edge, d, trusted), T.verdicts(d, trusted, d.select("id"), d.select("id"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_types_and_declarations_of_a_module_never_meet_as_pairs(spark):
    rng = random.Random(3)
    rows = [(k, f"M.n{k % 9}" + (".x" if k % 4 == 0 else ""), f"m{k % 2}", a := rng.choice([None, *range(1, 200)]), a and a + rng.randrange(-2, 90), rng.choice(["structure", "class", "instance", "def"])) for k in range(300)]
    d = frame(spark, rows, "id long, name string, module string, range_start int, range_end int, kind string")
    inside = {r for r in rows if r[3] and any(h[5] in ("structure", "class") and h[3] and h[2] == r[2] and h[3] <= r[3] and r[4] <= h[4] and (h[3] < r[3] or r[4] < h[4]) for h in rows)}
    made = {(r[1], r[2]) for r in inside if r[5] == "instance"}
    found = G.derived_instance_clusters(d)
    assert {r.id for r in found.collect()} == {r[0] for r in inside if any(m == r[2] and (r[1] == n or r[1].startswith(n + ".")) for n, m in made)}
    assert "cell" not in found._jdf.queryExecution().analyzed().toString()


def test_imports_are_read_once_for_all_levels(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    chain = frame(spark, [(f"m{k}", f"m{k + 1}") for k in range(6)], "module string, imported string")
    chain = spark.createDataFrame(chain.rdd.mapPartitions(counted), "module string, imported string")
    module = frame(spark, [(f"m{k}", True) for k in range(6)], "module string, in_build_dir boolean")
    problems = G.closure_problems(module, chain, frame(spark, [("m0",)], "module string")).collect()
    assert [tuple(r) for r in problems] == [("m6", "unresolved", "m5")] and seen.value == 6
