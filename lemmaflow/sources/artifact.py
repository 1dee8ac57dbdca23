"""Extract artifacts: JSON documents that hold an object of atoms by code name, bare or in an envelope."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.plans.scratch import shared_folder
from lemmaflow.sources.jsonobject import DocumentError, read_members, surroundings

# The atom's fields in the published document.
LINES = "struct<`lines-start`:int,`lines-end`:int>"
ALWAYS = [("display-name", "string"), ("kind", "string"), ("language", "string"), ("dependencies", "array<string>"), ("type-dependencies", "array<string>"), ("term-dependencies", "array<string>"), ("code-module", "string"), ("code-path", "string")]
NULLABLE = [("code-text", LINES), ("rust-source", "string")]
FLAGS = ["is-hidden", "is-lean-generated", "is-aeneas-generated", "is-ignored", "is-relevant", "is-in-package", "is-protected", "is-primary-spec", "codomain-is-prop", "codomain-last-arg-is-bool"]
NOT_EMPTY = ["type-dependencies-external", "term-dependencies-external", "attributes", "specs"]
IF_ANY = [("primary-spec", "string"), ("verification-status", "string"), ("trusted-reason", "string"), ("status-origin", "string"), ("assumptions", "array<string>"), ("codomain-head", "string")]
FIELDS = [*ALWAYS, *NULLABLE, *[(f, "boolean") for f in FLAGS], *[(f, "array<string>") for f in NOT_EMPTY], *IF_ANY]
KINDS = ["def", "theorem", "abbrev", "class", "structure", "inductive", "instance", "axiom", "opaque", "quot", "projection"]
STATUSES = ["transitively-verified", "verified", "unverified", "failed", "trusted"]
TRUE_IF_ABSENT = {"is-relevant", "is-in-package"}
STRICT = ["status-origin", "assumptions"]
SCHEMA_VERSION = "3.0"

ATOM = "struct<" + ",".join(f"`{n}`:{t}" for n, t in FIELDS) + ">"


class ArtifactError(ValueError):
    """A document that breaks the contract."""


# The envelope around a document's data.
ENVELOPE = "struct<schema:string,`schema-version`:string,tool:struct<name:string,version:string,command:string>,source:struct<repo:string,commit:string,language:string,package:string,`package-version`:string>,timestamp:string>"


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """What stands around the data of each document; null fields where it is bare. The data itself isn't parsed."""
    return surroundings(spark, path).select(F.from_json("around", ENVELOPE).alias("e")).select("e.*")


def entries(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(name, atom as variant), one row for each entry of the documents at ``path``; with ``parts`` the files of a folder are one document.

    An envelope is an object with a string ``schema`` and ``data``. A document of any
    size is read by many tasks; see ``read_members``.
    """
    try:
        return read_members(spark, path, parts).select("name", F.col("value").alias("atom"))
    except DocumentError as e:
        raise ArtifactError(str(e)) from e


def read_atoms(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """The atoms of an artifact, a column for each field, with the reader's defaults.

    Missing flags are false, but relevant and in-package are true; a missing language is
    ``lean``. A status origin or assumption list that is present but null, and a
    protected flag that is no boolean, are errors.
    """
    return typed_atoms(entries(spark, path, parts))


def typed_atoms(found: DataFrame) -> DataFrame:
    """The columns of ``read_atoms`` from (name, atom as variant)."""
    present = lambda f: F.try_variant_get("atom", f"$['{f}']", "variant")
    null = lambda f: F.coalesce(F.is_variant_null(present(f)), F.lit(False))
    protected = present("is-protected")
    wrong = protected.isNotNull() & (F.schema_of_variant(protected) != "BOOLEAN")
    bad = found.where(null(STRICT[0]) | null(STRICT[1]) | wrong).select("name").take(1)
    if bad:
        raise ArtifactError(f"atom {bad[0]['name']}: a strict field is null or of the wrong type")
    x = found.select("name", F.from_json(F.to_json("atom"), ATOM).alias("a"))
    out = {}
    for field, kind in FIELDS:
        value = x["a"][field]
        if kind == "boolean":
            value = F.coalesce(value, F.lit(field in TRUE_IF_ABSENT))
        elif field == "language":
            value = F.coalesce(value, F.lit("lean"))
        elif kind == "array<string>" and field != "assumptions":
            value = F.coalesce(value, F.array().cast(kind))
        out[field] = value
    return x.select("name", *[v.alias(n) for n, v in out.items()])


def atom_json(atoms: DataFrame) -> Column:
    """An atom as JSON: fixed fields always, nullable ones as null, the others only if they have something to say."""
    shown = F.struct(*[F.col(f"`{n}`").alias(n) for n, _ in [*ALWAYS, *NULLABLE]], *[F.col(f"`{f}`").alias(f) for f in FLAGS])
    optional = F.struct(*[F.when(F.size(F.col(f"`{f}`")) > 0, F.col(f"`{f}`")).alias(f) for f in NOT_EMPTY], *[F.col(f"`{n}`").alias(n) for n, _ in IF_ANY])
    a, b = F.to_json(shown, {"ignoreNullFields": "false"}), F.to_json(optional, {"ignoreNullFields": "true"})
    return F.when(b == "{}", a).otherwise(F.concat(F.expr("''"), F.regexp_replace(a, r"\}$", ","), F.substring(b, 2, 1 << 30)))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def joined(spark: SparkSession, parts: str, path: str) -> None:
    """One file, ``part-00000.json`` in the folder ``path``, of the part files in the folder ``parts``, joined as bytes in order of their names.

    The file system has no way to join files that every store knows, so their bytes are
    copied through a buffer of a megabyte; nothing is parsed or held.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    files, out_files = source.getFileSystem(conf), target.getFileSystem(conf)
    if out_files.exists(target):
        raise FileExistsError(path)
    unfinished, whole = hadoop.fs.Path(target, "_whole"), hadoop.fs.Path(target, "part-00000.json")
    out = out_files.create(unfinished)
    try:
        for part in sorted(str(s.getPath()) for s in files.listStatus(source) if s.getPath().getName().startswith("part-")):
            read = files.open(hadoop.fs.Path(part))
            try:
                hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            finally:
                read.close()
    finally:
        out.close()
    out_files.rename(unfinished, whole)


def write_document(rows: DataFrame, path: str, envelope: dict, whole: bool = True) -> None:
    """Writes one JSON document of ``rows`` (name, body as JSON) as text, names in descending order; duplicate names keep one body.

    ``envelope`` has schema, tool, source and timestamp. Tasks write sorted ranges side by
    side, which in order of their names are the document; ``whole`` joins them into one
    file. Without it they stay as they are, for ``read_atoms`` with ``parts``.
    """
    spark = rows.sparkSession
    head = json.dumps(envelope | {"schema-version": SCHEMA_VERSION}, indent=2)[:-2] + ',\n  "data": {'
    one = rows.groupBy("name").agg(F.min("body").alias("body"))
    lines = one.select("name", F.concat(F.lit("    "), quoted(F.col("name")), F.lit(": "), "body").alias("line"))
    least = rows.agg(F.min("name")).first()[0]
    lines = lines.select(F.lit(1).alias("part"), "name", F.concat("line", F.when(F.col("name") == F.lit(least), F.lit("")).otherwise(F.lit(","))).alias("line"))
    frame = spark.createDataFrame([(0, "", head), (2, "", "  }\n}")], "part int, name string, line string")
    parts = f"{shared_folder(spark)}/lemmaflow/document-{uuid.uuid4().hex}" if whole else path
    lines.union(frame).orderBy("part", F.desc("name")).select("line").write.text(parts)
    if whole:
        joined(spark, parts, path)


def write_artifact(atoms: DataFrame, path: str, envelope: dict, whole: bool = True) -> None:
    """The atoms as one document; see ``write_document``."""
    write_document(atoms.select("name", atom_json(atoms).alias("body")), path, envelope, whole)


def write_lines(atoms: DataFrame, path: str) -> None:
    """The atoms as text files of one JSON object a line, (name, atom), sorted over all files; every task writes its own range."""
    rows = atoms.select("name", F.concat(F.lit('{"name":'), quoted(F.col("name")), F.lit(',"atom":'), atom_json(atoms), F.lit("}")).alias("line"))
    rows.orderBy(F.desc("name")).select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_lines`` wrote, as ``read_atoms`` gives it."""
    v = spark.read.text(path).select(F.parse_json("value").alias("v"))
    return typed_atoms(v.select(F.try_variant_get("v", "$.name", "string").alias("name"), F.try_variant_get("v", "$.atom", "variant").alias("atom")))


# The fields of molecules and of specification entries.
MOLECULE = "struct<`code-path`:string,`code-lines`:string,`code-name`:string,`rust-path`:string,`rust-lines`:struct<`lines-start`:int,`lines-end`:int>,`rust-name`:string,`spec-path`:string,`spec-lines`:string,`spec-name`:string>"
SPEC_ENTRY = "struct<specified:boolean,`code-path`:string,`spec-text`:struct<`lines-start`:int,`lines-end`:int>>"
#: Fields that a molecule or entry must have.
NEEDED = {MOLECULE: ["code-name", "rust-path", "rust-lines", "rust-name"], SPEC_ENTRY: ["specified", "code-path"]}


def write_molecules(molecules: DataFrame, path: str, envelope: dict) -> None:
    """The molecules of a view as one document by view key; what is unknown is null."""
    whole = F.struct(
        F.col("code_path").alias("code-path"), F.col("code_lines").alias("code-lines"), F.col("code_name").alias("code-name"), F.col("rust_path").alias("rust-path"),
        F.struct(F.col("rust_start").alias("lines-start"), F.col("rust_end").alias("lines-end")).alias("rust-lines"),
        F.col("rust_name").alias("rust-name"), F.col("spec_path").alias("spec-path"), F.col("spec_lines").alias("spec-lines"), F.col("spec_name").alias("spec-name"),
    )
    write_document(molecules.select(F.col("view_key").alias("name"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("body")), path, envelope)


def write_spec_entries(entries_: DataFrame, path: str, envelope: dict) -> None:
    """Specification entries (name, specified, code_path, lines_start, lines_end) as one document."""
    lines = F.when(F.col("lines_start").isNotNull(), F.struct(F.col("lines_start").alias("lines-start"), F.col("lines_end").alias("lines-end")))
    whole = F.struct("specified", F.col("code_path").alias("code-path"), lines.alias("spec-text"))
    write_document(entries_.select("name", F.to_json(whole, {"ignoreNullFields": "false"}).alias("body")), path, envelope)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name, the fields of ``kind``) of a document of molecules or specification entries; a missing or null needed field is an error."""
    found = entries(spark, path).select("name", F.from_json(F.to_json("atom"), kind).alias("x"))
    lost = F.array_compact(F.array(*[F.when(F.col(f"x.`{f}`").isNull(), F.lit(f)) for f in NEEDED[kind]]))
    bad = found.select("name", lost.alias("lost")).where(F.size("lost") > 0).take(1)
    if bad:
        raise ArtifactError(f"{bad[0]['name']}: no {bad[0]['lost'][0]}")
    return found.select("name", "x.*")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, MOLECULE)


def read_spec_entries(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SPEC_ENTRY)


def invalid_atoms(atoms: DataFrame) -> DataFrame:
    """(name, field): kinds and statuses outside the published lists."""
    kind, status = ~F.col("kind").isin(KINDS), F.col("`verification-status`").isNotNull() & ~F.col("`verification-status`").isin(STATUSES)
    return atoms.select("name", F.explode(F.array_compact(F.array(F.when(kind, F.lit("kind")), F.when(status, F.lit("verification-status"))))).alias("field"))


def example_atoms(spark: SparkSession) -> DataFrame:
    """A small artifact with every status, a tie between specifications, and both kinds of dependencies."""
    def ref(n: str) -> str:
        return f"probe:Example.{n}"

    rows = [  # name, kind, status, reason, line, type dependencies, term dependencies, assumptions, tagged
        ("Shape", "structure", "transitively-verified", None, 4, [], [], [], False),
        ("Shape.size", "projection", "transitively-verified", None, 8, ["Shape"], [], [], False),
        ("given", "axiom", "trusted", "axiom", 11, [], [], ["Example.given"], False),
        ("outer", "def", "trusted", "external", 2, [], [], [], False),
        ("area", "def", "transitively-verified", None, 15, ["Shape"], ["Shape.size"], [], False),
        ("area_spec", "theorem", "transitively-verified", None, 20, ["area"], [], [], True),
        ("area_bound", "theorem", "transitively-verified", None, 26, ["area"], ["given"], ["Example.given"], True),
        ("open", "theorem", "unverified", None, 31, ["area"], [], ["sorryAx"], False),
        ("after", "theorem", "verified", None, 37, [], ["open"], ["sorryAx"], False),
    ]
    specs = {"area": ["area_bound", "area_spec"]}
    out = []
    for name, kind, status, reason, line, types, terms, held, tagged in rows:
        module = "Example.CoreExternal" if reason == "external" else "Example.Core"
        flags = {f: f in ("is-relevant", "is-in-package") or (f == "is-primary-spec" and tagged) or (f == "codomain-is-prop" and kind in ("theorem", "axiom")) for f in FLAGS}
        atom = {"display-name": name.split(".")[-1], "kind": kind, "language": "lean", "dependencies": sorted({*map(ref, types + terms)}), "type-dependencies": [*map(ref, types)], "term-dependencies": [*map(ref, terms)], "code-module": module, "code-path": module.replace(".", "/") + ".lean", "code-text": (line, line + 2), "rust-source": None} | flags
        atom |= {f: [] for f in NOT_EMPTY} | {"attributes": ["primary_spec"] if tagged else [], "specs": [*map(ref, specs.get(name, []))]}
        atom |= {"primary-spec": ref("area_spec") if name in specs else None, "verification-status": status, "trusted-reason": reason, "status-origin": "kernel-taint" if status == "verified" else None, "assumptions": held, "codomain-head": None}
        out.append((ref(name), *[atom[f] for f, _ in FIELDS]))
    return spark.createDataFrame(out, "name string, " + ", ".join(f"`{f}` {kind}" for f, kind in FIELDS))
