"""Gates over whole documents: good ones pass, and each thing that may be wrong is named."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import audit, gates
from lemmaflow.sources import artifact as A
from lemmaflow.sources.lines import carried, lines_of, numbered, read_lines, running

TOOL = {"name": "exporter", "version": "0.20.0"}


def atom(status="transitively-verified", deps=(), **more):
    return {"display-name": "x", "kind": "def", "dependencies": list(deps), "type-dependencies": [], "term-dependencies": list(deps), "code-module": "M", "code-path": "M.lean", "code-text": None, "rust-source": None, "verification-status": status} | more


def save(tmp_path, atoms, name="a.json", **more):
    path = tmp_path / name
    path.write_text(json.dumps({"schema": "s", "tool": TOOL, "data": atoms} | more))
    return str(path)


GOOD = {"a": atom("unverified"), "b": atom("verified", ["a"], **{"status-origin": "kernel-taint"}), "c": atom(deps=["T.mk", "gone"]), "T": atom(kind="structure"), "t": atom("trusted")}


def test_a_sound_graph_passes(spark, tmp_path):
    got = gates.graph_gate(spark, save(tmp_path, GOOD), "exporter")
    assert got["divergences"].count() == 0 and got["without_status"].count() == 0
    assert {(r.name, r.is_member) for r in got["missing"].collect()} == {("T.mk", True), ("gone", False)}


def test_divergences_in_both_directions(spark, tmp_path):
    data = GOOD | {"d": atom(deps=["b"]), "e": atom("verified", ["t"], **{"status-origin": "kernel-taint"}), "f": atom("verified", ["a"]), "g": atom("trusted", ["a"]), "h": atom(deps=["g"])}
    got = gates.graph_gate(spark, save(tmp_path, data), "exporter")["divergences"]
    assert {(r.id, r.finding) for r in got.collect()} == {("d", "reaches a failure"), ("f", "reaches a failure"), ("e", "reaches none")}


@pytest.mark.parametrize(
    "broken",
    [
        {"data": []},
        {"tool": {"name": "other", "version": "1.0.0"}},
        {"tool": {"name": "exporter"}},
        {"tool": {"name": "exporter", "version": "0.15.9"}},
        {"tool": {"name": "exporter", "version": "1.x.0"}},
        {"schema": 3},
        {"data": {"a": 3}},
        {"data": {"a": atom() | {"dependencies": "b"}}},
        {"data": {"a": atom() | {"dependencies": ["b", 3]}}},
        {"data": {"a": atom() | {"dependencies": ["b", None]}}},
        {"data": {"a": atom("great")}},
        {"data": {"a": atom("verified", **{"status-origin": "elsewhere"})}},
        {"data": {"a": atom("unverified", **{"status-origin": "kernel-taint"})}},
        {"data": {"a": atom(kind=3)}},
        {"data": {"a": atom(None), "b": atom("trusted")}},
    ],
)
def test_documents_that_cannot_be_judged(spark, tmp_path, broken):
    with pytest.raises(gates.InputError):
        gates.graph_gate(spark, save(tmp_path, GOOD, **broken), "exporter")
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps(GOOD))
    with pytest.raises(gates.InputError, match="no envelope"):
        gates.check_envelope(spark, str(bare), "exporter")


REPORT = """Project of 3 modules
2 constant(s) rest on an unexcused project sorry:
  bad name [direct]
  b
4 trusted constant(s) (T):
  t axiom
"""


def test_status_gate(spark, tmp_path):
    data = {"probe:bad name": atom("unverified", assumptions=["sorryAx"]), "probe:b": atom("verified", assumptions=["ax", "sorryAx"], **{"status-origin": "kernel-taint"}), "probe:c": atom(assumptions=[]), "probe:t": atom("trusted", assumptions=["t"])}
    report = lambda text: lines_of(spark.createDataFrame([("r", text)], "path string, value string"))
    atoms = A.read_atoms(spark, save(tmp_path, data))
    assert gates.status_gate(atoms, report(REPORT)).count() == 0
    assert {r.problem for r in gates.status_gate(atoms, report(REPORT.replace("2 constant", "3 constant"))).collect()} == {"the header says 3, listed are 2"}
    assert "no tainted header" in {r.problem for r in gates.status_gate(atoms, report("nothing")).collect()}
    wrong = {"probe:a": atom("verified", assumptions=[]), "probe:b": atom("trusted"), "probe:c": atom("transitively-verified", assumptions=["b", "a"]), "probe:d": atom(None, assumptions=[]), "probe:u": atom("unverified", assumptions=[])}
    text = REPORT.replace("2 constant(s)", "4 constant(s)").replace("  b\n", "  b\n  c [direct] [not emitted]\n  nowhere\n")
    got = {(r.name, r.problem) for r in gates.status_gate(A.read_atoms(spark, save(tmp_path, wrong)), report(text)).collect()}
    assert got == {
        ("a", "verified, but not listed"), ("b", "trusted, but listed"), ("b", "no assumptions"), ("b", "listed, but the origin says otherwise"),
        ("c", "transitively verified, but listed"), ("c", "listed as not shown, but an atom"), ("c", "assumptions unsorted or repeated"),
        ("d", "no status"), ("d", "assumptions without a status"), ("u", "unverified, but not listed as direct"),
        ("u", "tainted without the placeholder among its assumptions"), ("bad name", "listed as shown, but no atom"), ("nowhere", "listed as shown, but no atom"),
    }


def plain_subsequence(old, new):
    at = 0
    for x in old:
        if x not in new[at:]:
            return False
        at = new.index(x, at) + 1
    return True


def test_subsequences(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(4))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "old array<string>, new array<string>").select("old", "new", gates.in_order(F.col("old"), F.col("new")).alias("ok")).collect()
    assert {r.ok for r in got} == {True, False} and all(r.ok == plain_subsequence(r.old, r.new) for r in got)


def test_comparison_of_artifacts(spark, tmp_path):
    old = {"probe:h": atom("unverified"), "probe:a": atom(deps=["probe:h"]), "probe:b": atom("verified", ["probe:h"]), "probe:c": atom("trusted"), "probe:d": atom(deps=["probe:a", "probe:c"]), "probe:gone": atom()}
    new = {"probe:h": atom(), "probe:a": atom("verified", ["probe:c", "probe:h"]), "probe:b": atom("transitively-verified", ["probe:h"]), "probe:c": atom("unverified"), "probe:d": atom(deps=["probe:c"]) | {"type-dependencies": ["probe:b"]}, "probe:new": atom()}
    a, b = A.read_atoms(spark, save(tmp_path, old, "o.json")), A.read_atoms(spark, save(tmp_path, new, "n.json"))
    found = lambda **k: {(r.check, r.name, r.detail) for r in gates.compare_artifacts(a, b, **k).collect()}
    always = {
        ("atom removed", "probe:gone", None), ("atom added", "probe:new", None), ("entries removed", "probe:d", "dependencies"), ("entries removed", "probe:d", "term-dependencies"),
        ("array changed", "probe:d", "type-dependencies"), ("not the union", "probe:d", None), ("not a subsequence", "probe:d", "dependencies"), ("not a subsequence", "probe:d", "term-dependencies"),
        ("status moved", "probe:c", "trusted -> unverified"),
    }
    moved = {("status moved", "probe:h", "unverified -> transitively-verified"), ("status moved", "probe:b", "verified -> transitively-verified")}
    assert found() == always | moved
    assert found(policy="taint", hosts=["probe:h"]) == always
    assert found(policy="taint", hosts=["probe:h", "probe:none"]) == always | {("unknown host", "probe:none", None)}
    want = spark.createDataFrame([("a", "term", "c"), ("b", "term", "x")], "atom string, bucket string, target string")
    assert found(policy="taint", hosts=["probe:h"], expected=want) == always | {("predicted but not added", "probe:b", "term x"), ("added but not predicted", "probe:d", "type b")}
    notes = {r.note: r.n for r in gates.comparison_notes(a, b).collect()}
    assert notes == {"added": 2, "atoms with added": 2, "verification-status changed": 4}
    assert gates.compare_artifacts(a, a).count() == 0


def test_audits_of_auxiliaries(spark):
    decl = spark.createDataFrame([("H", "A.H", False, "def"), ("T", "A.T", False, "theorem"), ("p", "A.H._proof_1", True, "theorem"), ("m", "A.H.match_2", True, "def"), ("x", "A.x", False, "def")], "id string, name string, aux boolean, kind string")
    edge = spark.createDataFrame([("H", "p", "value"), ("H", "m", "type"), ("T", "p", "value"), ("p", "x", "value"), ("m", "x", "value"), ("T", "x", "value")], "src string, dst string, role string")
    closure = spark.createDataFrame([("p", "x"), ("m", "x")], "src string, dst string")
    hosts = spark.createDataFrame([("H",), ("T",)], "id string")
    assert {tuple(r) for r in audit.shape_histogram(edge, decl, closure, hosts).collect()} == {("_proof_N", 2, 1, 1), ("match_N", 1, 1, 1)}
    assert tuple(audit.proof_carriers(edge, decl, decl.where("name LIKE '%proof%'")).first()) == (3, 1)
    assert {tuple(r) for r in audit.hidden_by_position(edge, closure, hosts).collect()} == {("type", 1, 1), ("value", 2, 1)}


def test_example_artifact_passes_every_gate(spark, tmp_path):
    A.write_artifact(A.example_atoms(spark), str(tmp_path / "x"), {"schema": "s", "tool": TOOL})
    path = str(next((tmp_path / "x").glob("part-*")))
    atoms = A.read_atoms(spark, path)
    assert atoms.count() == 9 and A.invalid_atoms(atoms).count() == 0
    assert gates.graph_gate(spark, path, "exporter")["divergences"].count() == 0
    report = "2 constant(s) rest on an unexcused project sorry:\n  Example.open [direct]\n  Example.after\n"
    assert gates.status_gate(atoms, lines_of(spark.createDataFrame([("r", report)], "path string, value string"))).count() == 0
    assert {r.name for r in gates.seeds(atoms).collect()} == {"probe:Example.open"}
    A.write_lines(atoms, str(tmp_path / "lines"))
    assert sorted(map(str, A.read_lines(spark, str(tmp_path / "lines")).collect())) == sorted(map(str, atoms.collect()))


def test_molecules_and_specification_entries(spark, tmp_path):
    from lemmaflow.operators.commands import viewify

    atoms = A.example_atoms(spark).withColumn("code-path", F.lit("P/Funs.lean"))
    view = viewify(atoms)
    A.write_molecules(view, str(tmp_path / "m"), {"schema": "s"})
    got = {r.name: r for r in A.read_molecules(spark, str(next((tmp_path / "m").glob("part-*")))).collect()}
    assert set(got) == {r.view_key for r in view.collect()} and got["P/Funs.lean/area"]["code-lines"] == "15-17" and got["P/Funs.lean/area"]["spec-lines"] is None
    rows = spark.createDataFrame([("a", True, "x", 1, 2), ("b", False, "y", None, None)], "name string, specified boolean, code_path string, lines_start int, lines_end int")
    A.write_spec_entries(rows, str(tmp_path / "s"), {"schema": "s"})
    back = {r.name: (r.specified, r["spec-text"]) for r in A.read_spec_entries(spark, str(next((tmp_path / "s").glob("part-*")))).collect()}
    assert back == {"a": (True, (1, 2)), "b": (False, None)}
    with pytest.raises(A.ArtifactError, match="no code-name"):
        A.read_molecules(spark, save(tmp_path, {"k": {"rust-path": ""}}))


def plain_report(text):
    """The listed constants and the last header's number, line by line."""
    listed, said, seen, inside = {}, None, 0, False
    for line in text.splitlines():
        head = re.fullmatch(r"([0-9]+) constant\(s\) rest on an unexcused project sorry:", line)
        if head:
            inside, said = True, int(head[1])
        elif not line.startswith("  "):
            inside = False
        elif inside:
            seen += 1
            m = re.fullmatch(r"(.*?)( \[direct\])?( \[not emitted\])?", line.strip())
            listed[m[1]] = (m[2] is not None, m[3] is None)
    return listed, said, seen


def test_a_long_report_in_small_blocks(spark, tmp_path):
    rng = random.Random(4)
    head = "{} constant(s) rest on an unexcused project sorry:"
    lines = ["  not listed", head.format(7), "  early", "end"] + [head.format(100_000)]
    lines += [f"  some name{k} {rng.choice(['', 'of [direct]', '[direct] [not emitted]', '[not emitted]', '[not emitted] [direct]'])} " for k in range(100_000)]
    lines += ["  some name5", "", "  after an empty line", "3 trusted constant(s) (T):", "  t axiom"]
    path = tmp_path / "report.txt"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        read = read_lines(spark, str(path))
        listed, problems = gates.parse_report(read)
        want, said, seen = plain_report("\n".join(lines))
        assert read.select("block").distinct().count() > 10
        assert {r.name: (r.direct, r.emitted) for r in listed.collect()} == want and len(want) >= 100_001
        assert [tuple(r) for r in problems.collect()] == [("report", f"the header says {said}, listed are {seen}")]
        assert [r.line for r in numbered(read).orderBy("line_no").collect()] == lines
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["", "  x", "1 constant(s) rest on an unexcused project sorry:", "x\r\n1 constant(s) rest on an unexcused project sorry:\r\n  a [direct]\r\n   \r\nz"])
def test_short_reports(spark, text):
    listed, problems = gates.parse_report(lines_of(spark.createDataFrame([("r", text)], "path string, value string")))
    want, said, seen = plain_report(text)
    assert {r.name: (r.direct, r.emitted) for r in listed.collect()} == want
    assert [r.problem for r in problems.collect()] == (["no tainted header"] if said is None else [] if said == seen else [f"the header says {said}, listed are {seen}"])
    assert gates.parse_report(lines_of(spark.createDataFrame([], "path string, value string")))[1].first().problem == "no tainted header"


def test_listings_are_capped(spark):
    rows = [("a", f"n{k:03}") for k in range(25)] * 2 + [("b", "z"), ("b", "y"), ("b", None), ("c", None)] + [("d", str(k)) for k in range(10)]
    got = {r.note: (r.n, r.names) for r in audit.listings(spark.createDataFrame(rows, "note string, name string")).collect()}
    assert got == {"a": (25, ", ".join(f"n{k:03}" for k in range(10)) + ", … and 15 more"), "b": (2, "y, z"), "d": (10, ", ".join(map(str, range(10))))}
    assert audit.listings(spark.createDataFrame([], "note string, name string")).count() == 0


def test_blocks_of_lines_are_not_broadcast(spark):
    lines = spark.createDataFrame([("p", k // 2, k, "x" if k == 1 else "y") for k in range(8)], "path string, block long, place long, line string")
    mark = F.when(F.col("line") == "x", F.lit("m"))
    for df in (carried(lines, mark, "last"), numbered(lines), running(lines, n=F.lit(1))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.last for r in carried(lines, mark, "last").orderBy("place").collect()] == [None] + ["m"] * 7
