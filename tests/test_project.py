"""Configuration, package files, workspace answers and targets."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lemmaflow.sources import artifact as A
from lemmaflow.sources import project as P


def test_configuration(spark, tmp_path):
    path = tmp_path / "config.json"
    assert P.load_config(spark, str(path)) == P.Config()
    path.write_text(json.dumps({"is-hidden": ["a"], "extraction-artifact-suffixes": ["_x"], "is-ignored": 3, "relevant-crate": "c"}))
    assert P.load_config(spark, str(path)) == P.Config(["a"], [], ["_x"], "c")
    path.write_text("{broken")
    assert P.load_config(spark, str(path)) == P.Config()
    atoms = spark.createDataFrame([("probe:a", False), ("probe:b_x", False), ("probe:_private.M.0.a", False)], "code_name string, f boolean").selectExpr("code_name", "f AS is_hidden", "f AS is_ignored", "f AS is_aeneas_generated")
    got = {r.code_name: (r.is_hidden, r.is_aeneas_generated) for r in P.flagged(atoms, P.Config(["a"], [], ["_x"])).collect()}
    assert got == {"probe:a": (True, False), "probe:b_x": (False, True), "probe:_private.M.0.a": (True, False)}


def test_package_and_paths(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    toml = 'name = "my-pkg"\nversion = "1.2.0"\n[[lib]]\nname = "other"\n'
    assert P.package_info(files(("x/lakefile.toml", toml)), "dir", "abcdef0123") == ("my-pkg", "1.2.0")
    assert P.package_info(files(("x/lake-manifest.json", '{"name": "m"}'), ("x/lakefile.toml", "[a]\nname = \"z\"")), "dir", "abcdef0123") == ("m", "abcdef0")
    assert P.package_info(files(("x/other", "")), "dir") == ("dir", "0.0.0")
    own, view = P.output_paths("p", "my-pkg", "1.2.0")
    assert own == "p/.verilib/probes/lean_my_pkg_1.2.0.json" and view.endswith("views/molecules_all.json")
    listing = lambda *rows: spark.createDataFrame(list(rows), "path string, modified int")
    assert P.default_atoms_path(listing((own, 1), ("p/lean_my_pkg_9.json", 5)), "my-pkg", "1.2.0") == own
    assert P.default_atoms_path(listing(("p/lean_my_pkg_1.json", 3), ("p/lean_my_pkg_2.json", 2), ("p/lean_other_3.json", 9)), "my-pkg", "1.2.0") == "p/lean_my_pkg_1.json"
    assert P.default_atoms_path(listing(("p/lean_other_3.json", 9)), "my-pkg", "1.2.0") is None


def test_a_project_folder_alone(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "My" / "Sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    assert P.find_atoms(spark, str(root)) is None and P.source_lines(spark, str(root)).count() == 0
    (root / "lakefile.toml").write_text('name = "my-pkg"\nversion = "1.2.0"\n')
    probes = root / ".verilib" / "probes"
    probes.mkdir(parents=True)
    for name, age in (("lean_my_pkg_0.9.json", 50), ("lean_my_pkg_1.0.json", 10), ("lean_other_2.json", 1), ("lean_my_pkg_1.1.txt", 0)):
        (probes / name).write_text("{}")
        os.utime(probes / name, (time.time() - age, time.time() - age))
    assert P.find_atoms(spark, str(root)).endswith("/lean_my_pkg_1.0.json")
    (probes / "lean_my_pkg_1.2.0.json").write_text("{}")
    os.utime(probes / "lean_my_pkg_1.2.0.json", (0, 0))
    assert P.find_atoms(spark, str(root) + "/").endswith("/lean_my_pkg_1.2.0.json")
    files = {"My/A.lean": "theorem a : T\n  b\n\nend", "My/Sub/B.lean": "\n".join(f"line {k}" for k in range(3000)), "Top.lean": "x"}
    for name, text in {**files, ".hidden/C.lean": "no", "My/note.txt": "no"}.items():
        (root / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [tuple(r) for r in P.source_lines(spark, str(root)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted((name, k, line) for name, text in files.items() for k, line in enumerate(text.split("\n"), 1))


def test_answers_and_requests(spark):
    lines = spark.createDataFrame([(0, "shell hook says hello"), (1, '{"libs": ["A"]}'), (2, "  ")], "line_no int, value string")
    assert P.answers(lines, "libs array<string>").first().libs == ["A"]
    names = spark.createDataFrame([("A.B",), ('«odd "name"»',), ("line\nbreak",)], "module string")
    sent = P.requests(names)
    assert all("\n" not in r.value for r in sent.collect())
    assert {r.module for r in P.asked_modules(sent.union(spark.createDataFrame([(" ",)], "value string"))).collect()} == {r.module for r in names.collect()}


def test_targets(spark):
    lib = spark.createDataFrame([("A", None), ("B", "cannot read\n")], "name string, error string")
    exe = spark.createDataFrame([("main", "Main")], "name string, root string")
    defaults = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    pick = lambda libs, every, *d: {(r.name, r.kind) for r in P.chosen_targets(lib, exe, defaults(*d), libs, every).collect()}
    assert pick(["A"], False) == {("A", "lib")} and pick(None, False, "A", "main", "custom") == {("A", "lib"), ("main", "exe")}
    for libs, every, d, problem in ((["A"], True, (), "either"), (["C"], False, (), "no such library: C"), (["B"], False, (), "B: cannot read"), (None, True, (), "not listed"), (None, False, ("custom",), "no target")):
        with pytest.raises(ValueError, match=problem):
            pick(libs, every, *d)
    assert {(r.name) for r in P.chosen_targets(lib.drop("error"), exe, defaults(), None, False).collect()} == {"A", "B"}
    targets = P.chosen_targets(lib, exe, defaults("A", "main"), None, False)
    modules = spark.createDataFrame([("A", "A.X", 0), ("A", "Main", 1), ("B", "B.X", 0)], "lib string, module string, pos int")
    assert [r.module for r in P.target_modules(targets, modules, exe).orderBy("place").collect()] == ["A.X", "Main"]
    assert {r.argument for r in P.build_arguments(targets, exe).collect()} == {"A:leanArts", "+Main"}
    assert P.library_names(" A, ,B ") == ["A", "B"]


def test_envelope(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"schema": "s", "schema-version": "3.0", "tool": {"name": "t", "version": "1"}, "source": {"package": "p", "package-version": "2"}, "data": {}}))
    row = A.read_envelope(spark, str(path)).first()
    assert (row.schema, row["schema-version"], row.tool.name, row.source["package-version"], row.timestamp) == ("s", "3.0", "t", "2", None)
    assert A.read_envelope(spark, str(path)).select(F.col("source.commit")).first()[0] is None
