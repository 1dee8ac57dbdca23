"""What surrounds a declaration dump: configuration, package files, workspace answers, artifact lookup."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions.names import config_flag, has_suffix, output_name, toml_field
from lemmaflow.sources.lines import numbered


@dataclass
class Config:
    """The user's lists; whatever can't be read is empty."""

    hidden: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    relevant_crate: str = ""


# Keys of the configuration document.
CONFIG_KEYS = {"hidden": "is-hidden", "ignored": "is-ignored", "suffixes": "extraction-artifact-suffixes", "relevant_crate": "relevant-crate"}


def load_config(spark: SparkSession, path: str) -> Config:
    """Reads the configuration; a missing or broken file gives the empty one, and a value of the wrong type an empty value."""
    kinds = {k: "string" if k == "relevant_crate" else "array<string>" for k in CONFIG_KEYS}
    try:
        v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        row = v.select(*[F.try_variant_get("v", f"$['{key}']", kinds[k]).alias(k) for k, key in CONFIG_KEYS.items()]).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Config()
    return Config(**{k: row[k] or ("" if k == "relevant_crate" else []) for k in CONFIG_KEYS}) if row else Config()


def flagged(atoms: DataFrame, config: Config) -> DataFrame:
    """``atoms`` with the configuration's flags on top of their own; a suffix marks generated atoms and never hides one."""
    name = F.col("code_name")
    return atoms.withColumns({
        "is_hidden": F.col("is_hidden") | config_flag(name, config.hidden),
        "is_ignored": F.col("is_ignored") | config_flag(name, config.ignored),
        "is_aeneas_generated": F.col("is_aeneas_generated") | has_suffix(name, config.suffixes),
    })


def package_info(files: DataFrame, folder: str, commit: str | None = None) -> tuple[str, str]:
    """(package, version) from ``files`` (path, text): the TOML file, then the manifest, then the folder's name; the version falls back on the commit."""
    toml = F.first(F.when(F.col("path").endswith("lakefile.toml"), F.col("text")), ignorenulls=True)
    manifest = F.first(F.when(F.col("path").endswith("lake-manifest.json"), F.get_json_object("text", "$.name")), ignorenulls=True)
    row = files.agg(toml.alias("toml"), manifest.alias("manifest")).select(F.coalesce(toml_field(F.col("toml"), "name"), "manifest", F.lit(folder)).alias("name"), F.coalesce(toml_field(F.col("toml"), "version"), F.lit(commit[:7] if commit else None), F.lit("0.0.0")).alias("version")).first()
    return row["name"], row["version"]


# Where outputs lie in a project.
PROBES, MOLECULES = ".verilib/probes", ".verilib/views/molecules_all.json"


def output_prefix(package: str) -> str:
    return "lean_" + package.replace("-", "_") + "_"


def output_paths(folder: str, package: str, version: str) -> tuple[str, str]:
    """Where a project's artifact and its view belong."""
    return f"{folder}/{PROBES}/{output_prefix(package)}{version}.json", f"{folder}/{MOLECULES}"


def default_atoms_path(listing: DataFrame, package: str, version: str) -> str | None:
    """The artifact's own file in a ``listing`` (path, modified), else the newest one of the package in any version."""
    exact = output_name(F.lit(package), F.lit(version))
    file = F.element_at(F.split("path", "/"), -1)
    own = F.first(F.when(file == exact, F.col("path")), ignorenulls=True)
    alike = file.startswith(output_prefix(package)) & file.endswith(".json")
    newest = F.max_by("path", F.when(alike, F.col("modified")))
    return listing.agg(F.coalesce(own, newest)).first()[0]


def listed_files(spark: SparkSession, folder: str, pattern: str, deep: bool = False) -> DataFrame:
    """(path, modified, size) of a folder's files by name, from the file system alone: nothing is read. A folder that isn't there is empty."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
        return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modified timestamp, size bigint")


def package_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the files in ``folder`` that say what package it is."""
    paths = [r["path"] for name in ("lakefile.toml", "lake-manifest.json") for r in listed_files(spark, folder, name).collect()]
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def find_atoms(spark: SparkSession, folder: str, commit: str | None = None) -> str | None:
    """The artifact that belongs to the project in ``folder``: its own version's, or else the newest of the package by time."""
    folder = folder.rstrip("/")
    package, version = package_info(package_files(spark, folder), folder.rsplit("/", 1)[-1], commit)
    return default_atoms_path(listed_files(spark, f"{folder}/{PROBES}", "*.json"), package, version)


def source_lines(spark: SparkSession, folder: str, pattern: str = "*.lean") -> DataFrame:
    """(path, line_no, text) of every source file under ``folder``, paths relative to it; hidden folders are left out.

    Files are read in the blocks that Spark splits them into, so a file of any length is
    the work of many tasks.
    """
    files = listed_files(spark, folder, pattern, deep=True)
    if files.isEmpty():
        return spark.createDataFrame([], "path string, line_no bigint, text string")
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    root = F.lit(folder.rstrip("/").split("://")[-1].removeprefix("file:") + "/")
    return numbered(lines).select(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), 2), -1).alias("path"), "line_no", F.col("line").alias("text"))


def answers(lines: DataFrame, schema: str) -> DataFrame:
    """Helper output decoded: the last line with text of ``lines`` (line_no, value) as JSON."""
    last = lines.where("trim(value) <> ''").agg(F.max_by("value", "line_no").alias("value"))
    return last.select(F.from_json("value", schema).alias("x")).select("x.*")


def requests(names: DataFrame) -> DataFrame:
    """Module names as lines of JSON strings, as the ownership helper reads them."""
    return names.select(F.expr("substring(to_json(array(module)), 2, length(to_json(array(module))) - 2)").alias("value"))


def asked_modules(lines: DataFrame) -> DataFrame:
    """Module names back from lines of JSON strings (value); empty lines don't count."""
    return lines.where("trim(value) <> ''").select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("module"))


def library_names(argument: str) -> list[str]:
    return [x.strip() for x in argument.split(",") if x.strip()]


def chosen_targets(lib: DataFrame, exe: DataFrame, default_target: DataFrame, libraries: list[str] | None, all_libraries: bool) -> DataFrame:
    """Targets (name, kind): the libraries asked for, or all, or the defaults, or every library.

    Defaults that are neither a library nor a program are passed over. Unknown libraries,
    libraries whose modules could not be listed (``lib`` may have ``error``), and no
    target at all are errors.
    """
    if libraries and all_libraries:
        raise ValueError("either some libraries or all of them")
    libs, exes = lib.select("name", F.lit("lib").alias("kind")), exe.select("name", F.lit("exe").alias("kind"))
    if libraries:
        unknown = set(libraries) - {r["name"] for r in libs.where(F.col("name").isin(libraries)).collect()}
        if unknown:
            raise ValueError("no such library: " + ", ".join(sorted(unknown)))
        chosen = libs.where(F.col("name").isin(libraries))
    else:
        chosen = libs if all_libraries or default_target.isEmpty() else libs.union(exes).join(default_target.select("name"), "name", "left_semi")
    if chosen.isEmpty():
        raise ValueError("no target")
    if "error" in lib.columns:
        broken = lib.where("error IS NOT NULL").join(chosen.where("kind = 'lib'"), "name", "left_semi").orderBy("name").take(10)
        if broken:
            raise ValueError("modules not listed: " + "; ".join(f"{r['name']}: {r['error'].strip()}" for r in broken))
    return chosen


def build_arguments(targets: DataFrame, exe: DataFrame) -> DataFrame:
    """(argument) of a build: a library's compiled parts, a program's root module."""
    libs = targets.where("kind = 'lib'").select(F.concat("name", F.lit(":leanArts")).alias("argument"))
    return libs.union(targets.where("kind = 'exe'").join(exe, "name").select(F.concat(F.lit("+"), "root")))


def target_modules(targets: DataFrame, lib_module: DataFrame, exe: DataFrame) -> DataFrame:
    """(module, place): modules of the libraries in order, then roots of the programs, each at its first place."""
    libs = targets.where("kind = 'lib'").join(lib_module.withColumnRenamed("lib", "name"), "name").select("module", F.struct(F.lit(0).alias("k"), "name", "pos").alias("place"))
    roots = targets.where("kind = 'exe'").join(exe, "name").select(F.col("root").alias("module"), F.struct(F.lit(1).alias("k"), "name", F.lit(0).alias("pos")).alias("place"))
    return libs.union(roots).groupBy("module").agg(F.min("place").alias("place"))
