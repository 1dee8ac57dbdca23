import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from lemmaflow.sources import artifact as A
from lemmaflow.sources import jsonobject
from lemmaflow.sources.jsonobject import surroundings

ATOM = {"display-name": "x", "kind": "def", "dependencies": ["probe:b"], "type-dependencies": [], "term-dependencies": ["probe:b"], "code-module": "M", "code-path": "M.lean", "code-text": {"lines-start": 1, "lines-end": 2}, "rust-source": None}


def save(tmp_path, document):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(document))
    return str(path)


def test_bare_and_enveloped_documents_read_alike(spark, tmp_path):
    bare = A.read_atoms(spark, save(tmp_path, {"probe:a": ATOM})).first()
    wrapped = A.read_atoms(spark, save(tmp_path, {"schema": "s", "data": {"probe:a": ATOM}})).first()
    assert bare == wrapped
    assert (bare["language"], bare["is-relevant"], bare["is-hidden"], bare["assumptions"], bare["specs"]) == ("lean", True, False, None, [])


@pytest.mark.parametrize("field", [{"assumptions": None}, {"status-origin": None}, {"is-protected": "yes"}])
def test_strict_fields(spark, tmp_path, field):
    with pytest.raises(A.ArtifactError):
        A.read_atoms(spark, save(tmp_path, {"probe:a": ATOM | field}))


def test_round_trip(spark, tmp_path):
    source = {"probe:a": ATOM | {"assumptions": [], "specs": ["probe:s"]}, "probe:b\"q": ATOM | {"verification-status": "trusted"}}
    atoms = A.read_atoms(spark, save(tmp_path, source))
    A.write_artifact(atoms, str(tmp_path / "out"), {"schema": "x/extract", "timestamp": "t"})
    (part,) = glob.glob(str(tmp_path / "out" / "part-*"))
    document = json.loads(open(part).read())
    assert list(document["data"]) == ['probe:b"q', "probe:a"]
    a = document["data"]["probe:a"]
    assert a["assumptions"] == [] and a["rust-source"] is None and "attributes" not in a and a["specs"] == ["probe:s"]
    assert sorted(map(str, A.read_atoms(spark, part).collect())) == sorted(map(str, atoms.collect()))


def random_value(rng, depth=0):
    """A JSON value with marks and escapes in its strings."""
    text = lambda: "".join(rng.choices(['{', '}', '"', "\\", "[", "]", ",", ":", "a", "\n", "é", '"data": {', "😀"], k=rng.randrange(6)))
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind > 3:
        inner = [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
        return inner if kind == 4 else {f"{text()}{k}": v for k, v in enumerate(inner)}
    return (text(), rng.randrange(9), None, True)[kind]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_a_document_against_a_parser(spark, tmp_path, monkeypatch, seed):
    """Every entry, however the file is cut into blocks, bare or wrapped, pretty or on one line."""
    rng = random.Random(seed)
    data = {f"n{k}{rng.choice(['', '}', chr(34), ' {'])}": random_value(rng) for k in range(rng.choice([0, 1, 60]))}
    extra = {"inputs": [{"data": {}}, {"schema": "no"}], "note": 'a } "b" { c', "other": {"x": {"y": [{}]}}}
    front = {k: v for k, v in extra.items() if rng.random() < 0.5}
    document = data if seed % 3 == 0 else front | {"schema": "s", "data": data} | {k: v for k, v in extra.items() if k not in front}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(document, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n "]))
    whole = A.entries(spark, str(path)).selectExpr("name", "to_json(atom) AS j").collect()
    monkeypatch.setattr(jsonobject, "WHOLE", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = A.entries(spark, str(path)).selectExpr("name", "to_json(atom) AS j").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.name: json.loads(r.j) for r in got} == data and len(got) == len(data)
    assert sorted(whole) == sorted(got)
    around = json.loads(surroundings(spark, str(path)).first().around)
    assert around == ({} if seed % 3 == 0 else document | {"data": None})


BROKEN = ["[1]", '{"a": 1', '{"a": {}} {"b": {}}', '{"a": {}} x', '{"a": {}, "a": {}}', '{"a": {}}}', '{"a": "}']
LATER = ['{"a": {} "b": {}}', '{"a": {}, }', '{"a": {x}}']


@pytest.mark.parametrize("text", [*BROKEN, *LATER])
def test_broken_documents(spark, tmp_path, monkeypatch, text):
    """A row each or cut, they are refused; what only parsing shows of a cut one comes with the rows."""
    path = tmp_path / "a.json"
    path.write_text(text)
    with pytest.raises(A.ArtifactError):
        A.entries(spark, str(path))
    monkeypatch.setattr(jsonobject, "WHOLE", 0)
    with pytest.raises(Exception, match="comma|MALFORMED|INVALID") if text in LATER else pytest.raises(A.ArtifactError):
        A.entries(spark, str(path)).collect()


def test_parts_side_by_side_are_the_document(spark, tmp_path):
    atoms = spark.range(3000).select(F.concat(F.lit("probe:n"), "id").alias("name"), F.to_json(F.struct(F.lit("}{").alias("display-name"), F.lit("def").alias("kind"))).alias("body"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        A.write_document(atoms, str(tmp_path / "parts"), {"schema": "s"}, whole=False)
        A.write_document(atoms, str(tmp_path / "one"), {"schema": "s"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(str(tmp_path / "parts" / "part-*")))
    (one,) = glob.glob(str(tmp_path / "one" / "part-*"))
    whole = open(one, "rb").read()
    assert len(parts) > 1 and b"".join(open(p, "rb").read() for p in parts) == whole
    assert list(json.loads(whole)["data"]) == sorted((f"probe:n{k}" for k in range(3000)), reverse=True)
    by_parts, by_one = (sorted(map(str, f.collect())) for f in (A.read_atoms(spark, str(tmp_path / "parts"), parts=True), A.read_atoms(spark, one)))
    assert by_parts == by_one and len(by_one) == 3000
    with pytest.raises(FileExistsError):
        A.write_document(atoms, str(tmp_path / "one"), {"schema": "s"})
