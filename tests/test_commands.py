import dataclasses
import glob

import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import graph as G
from lemmaflow.operators import trust as T
from lemmaflow.operators.commands import Dump, ProjectError, check_axioms, extract, published, viewify
from lemmaflow.sources import artifact as A

SCHEMA = """name_id string, name string, module string, owner_module string, is_kept boolean, ctor_kind string,
type_used array<string>, value_used array<string>, type_used_emitted array<string>, value_used_emitted array<string>, ctors array<string>,
type_is_prop boolean, externally_verified_tag boolean, primary_spec_tag boolean, range_start int, range_end int,
is_instance boolean, is_class boolean, is_structure boolean, is_projection boolean, is_abbrev boolean, is_protected boolean,
is_universe_typed boolean, is_bv_decide_type boolean, codomain_is_prop boolean, codomain_is_type boolean, codomain_last_arg_is_bool boolean,
codomain_head string, step_program_head string, docstring string, body_docstring string, type_pp string"""

ROWS = [  # name, module, kind, type, value, range
    ("f", "P.Funs", "defn", [], ["_aux"], 1),
    ("_aux", "P.Funs", "defn", [], ["g"], None),
    ("g", "P.Funs", "defn", [], [], 5),
    ("f_spec", "P.Funs", "thm", ["f"], ["lem"], 9),
    ("lem", "P.Funs", "thm", [], ["sorryAx"], 12),
    ("ax", "P.Funs", "axiom", ["f"], [], 15),
    ("use", "P.Funs", "thm", [], ["ax"], 18),
    ("sorryAx", "Core", "axiom", [], [], 1),
    ("dep", "Dep.M", "defn", [], [], 1),
]


def constant(name, module, kind, types=(), values=(), line=None, *, owner=None, kept=True, tagged=False):
    flags = [False] * 6 + [False] * 5
    return (name, name, module, owner or module, kept, kind, list(types), list(values), list(types), list(values), [], kind == "thm", tagged, False, line, line and line + 2, *flags, None, None, None, None, None)


def dump(spark):
    rows = [constant(name, module, kind, types, values, line) for name, module, kind, types, values, line in ROWS]
    module = spark.createDataFrame([("P.Funs", True), ("Core", False), ("Dep.M", False)], "module string, in_build_dir boolean")
    imports = spark.createDataFrame([("P.Funs", "Core"), ("P.Funs", "Dep.M")], "module string, imported string")
    return Dump(spark.createDataFrame(rows, SCHEMA), module, imports, spark.createDataFrame([("P.Funs",)], "module string"))


def test_extract(spark):
    got = {r.id: r for r in extract(dump(spark)).collect()}
    assert set(got) == {"f", "g", "f_spec", "lem", "ax", "use"}
    assert {k: r.status for k, r in got.items()} == {"f": "transitively-verified", "g": "transitively-verified", "f_spec": "verified", "lem": "unverified", "ax": "trusted", "use": "transitively-verified"}
    assert got["f"].term_deps == ["probe:g"] and got["f"].specs == ["probe:f_spec"] and got["f"].primary_spec == "probe:f_spec"
    assert got["use"].assumptions == ["ax"] and got["f_spec"].assumptions == ["sorryAx"] and got["g"].assumptions == []


def test_check_axioms_and_view(spark):
    report = check_axioms(dump(spark))
    assert {(r.name, r.is_direct) for r in report["tainted"].collect()} == {("lem", True), ("f_spec", False)}
    assert [r.id for r in report["trusted"].collect()] == ["ax"]
    assert {(r.label, r.category, r.n) for r in report["assumptions"].collect()} == {("ax", "project axiom", 2), ("sorryAx", "sorry", 2)}
    keys = {r.view_key for r in viewify(published(extract(dump(spark), skip_verify=True))).collect()}
    assert "P/Funs.lean/probe:f" in keys and len(keys) == 6


def test_extract_writes_an_artifact_that_reads_and_shows_the_same(spark, tmp_path):
    atoms = published(extract(dump(spark)))
    A.write_artifact(atoms, str(tmp_path / "out"), {"schema": "x/extract", "tool": {"name": "x", "version": "1.0.0", "command": "extract"}})
    (part,) = glob.glob(str(tmp_path / "out" / "part-*"))
    again = A.read_atoms(spark, part)
    assert sorted(map(str, again.collect())) == sorted(map(str, atoms.collect()))
    assert sorted(map(str, viewify(again).collect())) == sorted(map(str, viewify(atoms).collect()))
    got = {r.name: r for r in again.collect()}
    assert got["probe:f"]["code-text"]["lines-start"] == 1 and got["probe:f_spec"]["assumptions"] == ["sorryAx"] and got["probe:f"]["primary-spec"] == "probe:f_spec"


SOURCE = ["@[step]", "def f := g", "", "", "def g := 1", "", "", "", "@[simp, externally_verified] theorem f_spec : f", "", "", "theorem lem : True", "", "", "axiom ax : f", "", "", "theorem use : True"]


def test_attributes_from_source_and_the_tag_audit(spark):
    lines = spark.createDataFrame([("P/Funs.lean", k + 1, t) for k, t in enumerate(SOURCE)], "path string, line_no int, text string")
    d = dataclasses.replace(dump(spark), source_file=lines)
    got = {r.id: r for r in extract(d).collect()}
    assert got["f"].attributes == ["step"] and got["f_spec"].attributes == ["externally_verified", "simp"] and got["g"].attributes == []
    assert got["f"].code_path == "P/Funs.lean" and got["f"].lines_start == 1
    assert {(r.id, r.finding) for r in check_axioms(d)["tag_audit"].collect()} == {("f_spec", "scan-only")}
    away = dataclasses.replace(d, source_file=lines.withColumn("path", F.lit("elsewhere")))
    assert {(r.code_path, r.lines_start) for r in extract(away).collect()} == {("", None)}


def several(spark):
    """Names with versions: merged in the project, and shared with a dependency."""
    rows = [
        constant("m", "P.A", "thm", values=["a"], line=1),
        constant("m", "P.B", "thm", values=["sorryAx"], line=5, owner="P.A", kept=False),
        constant("a", "P.A", "defn", line=9),
        constant("m_user", "P.A", "thm", values=["m"], line=13),
        constant("x", "P.A", "thm", values=["a"], line=17, owner="Dep", kept=False),
        constant("x", "Dep", "thm", values=["dep_ax"]),
        constant("dep_ax", "Dep", "axiom"),
        constant("sorryAx", "Core", "axiom"),
        constant("ax2", "P.A", "axiom", line=21, kept=False),
        constant("ax2", "P.B", "thm", values=["a"], line=25),
        constant("only_dep", "Dep", "defn", values=["dep_ax"]),
        constant("uses_dep", "P.A", "defn", values=["only_dep"], line=29),
    ]
    module = spark.createDataFrame([("P.A", True), ("P.B", True), ("Dep", False), ("Core", False)], "module string, in_build_dir boolean")
    imports = spark.createDataFrame([("P.A", "Dep"), ("P.A", "P.B"), ("P.B", "Core")], "module string, imported string")
    return Dump(spark.createDataFrame(rows, SCHEMA), module, imports, spark.createDataFrame([("P.A",)], "module string"))


def test_versions_of_one_name(spark):
    got = {r.id: r for r in extract(several(spark)).collect()}
    assert {k: r.status for k, r in got.items()} == {"m": "unverified", "a": "transitively-verified", "m_user": "verified", "x": "transitively-verified", "ax2": "transitively-verified", "uses_dep": "transitively-verified"}
    assert (got["m"].module, got["m"].range_start) == ("P.A", 1) and got["m"].term_deps == ["probe:a"] and got["m"].term_deps_external == ["probe:sorryAx"]
    assert got["x"].module == "P.A" and got["x"].term_deps == ["probe:a"]
    assert {k: r.assumptions for k, r in got.items()} == {"m": ["sorryAx"], "a": [], "m_user": ["sorryAx"], "x": ["dep_ax"], "ax2": ["ax2"], "uses_dep": ["dep_ax"]}
    report = check_axioms(several(spark))
    assert {(r.name, r["class"]) for r in report["merges"].collect()} == {("m", "merged"), ("ax2", "merged"), ("x", "cross")}
    assert {r.root for r in report["dependency_roots"].collect()} == {"Dep", "Core"}


def test_projects_that_cannot_be_read(spark):
    d = dump(spark)
    lost = dataclasses.replace(d, module_import=d.module_import.union(spark.createDataFrame([("P.Funs", "Gone")], d.module_import.schema)))
    with pytest.raises(ProjectError, match="Gone, unresolved, P.Funs"):
        extract(lost)
    with pytest.raises(ProjectError, match="outside the build folder"):
        extract(dataclasses.replace(d, targets=spark.createDataFrame([("Core",)], "module string")))
    with pytest.raises(ProjectError, match="private parts"):
        extract(dataclasses.replace(d, module=d.module.selectExpr("*", "true AS is_module_system", "module <> 'P.Funs' AS has_parts")))
    two = d.constant.selectExpr("*", "'h' AS type_hash").union(d.constant.where("name = 'g'").selectExpr("*", "'other' AS type_hash").withColumn("module", F.lit("P.Two")))
    module = d.module.union(spark.createDataFrame([("P.Two", True)], d.module.schema))
    imports = d.module_import.union(spark.createDataFrame([("P.Funs", "P.Two")], d.module_import.schema))
    with pytest.raises(ProjectError, match="g, P.Funs and P.Two"):
        extract(dataclasses.replace(d, constant=two, module=module, module_import=imports))
    with pytest.raises(ValueError, match="no module"):
        extract(d, module_prefix="Q")


def test_report_tables_are_built_when_asked_for(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(T, "assumption_holders", lambda *a, **k: walked.append(a) or spark.createDataFrame([("ax", 2)], "label string, n long"))
    report = check_axioms(dump(spark))
    assert {r.id for r in report["tainted"].collect()} == {"lem", "f_spec"} and [r.id for r in report["trusted"].collect()] == ["ax"] and not walked
    assert {(r.place, r.n_labels) for r in report["categories"].collect()} == {(k, int(k == 4)) for k in range(7)} and report["assumptions"].count() == 1
    assert len(walked) == 1 and len(report) == len(list(report)) == 8


def test_names_of_two_modules_meet_without_a_broadcast(spark):
    d = dump(spark)
    d = dataclasses.replace(d, constant=d.constant.selectExpr("*", "'h' AS type_hash"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    version = d.constant.selectExpr("name", "module", "ctor_kind", "type_hash", "array('') AS level_params", "array(name) AS all_names", "false AS is_unsafe")
    assert "Broadcast" not in plan(G.coimport_collisions(version))
    assert "Broadcast" not in plan(G.unresolved_imports(d.module, d.module_import))
    assert "Broadcast" not in plan(G.dependency_roots(d.module, d.targets))
