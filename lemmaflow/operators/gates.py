"""Gates over published artifacts: what breaks the contract, and where two reports of one project disagree, as rows.

A gate passes if its violations are an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions.names import without_prefix
from lemmaflow.operators.audit import SEEDS, graph_divergences, missing_dependencies
from lemmaflow.plans.fixpoint import reaching
from lemmaflow.plans.scratch import sized
from lemmaflow.sources import artifact as A
from lemmaflow.sources.lines import PLACE, carried

# The mark of a status that the walk gave, the oldest version whose statuses can be read, the placeholder.
ORIGIN = "kernel-taint"
MIN_VERSION = (0, 16, 0)
SORRY = "sorryAx"
ARRAYS = ["dependencies", "type-dependencies", "term-dependencies"]
FIXED_ARRAYS = ["type-dependencies", "type-dependencies-external", "term-dependencies-external"]
# Statuses that may move, by policy.
MOVES = {"fold": [("transitively-verified", "verified")], "taint": [("transitively-verified", "verified"), ("trusted", "transitively-verified"), ("unverified", "verified")]}


class InputError(ValueError):
    """A document that a gate can't judge."""


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def check_envelope(spark: SparkSession, path: str, tool: str, oldest: tuple[int, int, int] = MIN_VERSION) -> None:
    """Raises unless the document is an envelope written by ``tool`` in a version from ``oldest`` on: the meaning of a status hangs on it."""
    get = lambda p, t: F.try_variant_get("v", p, t)
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    part = [F.try_to_number(F.regexp_extract(get("$.tool.version", "string"), r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:-.*)?$", k), F.lit("999999999")).cast("int") for k in (1, 2, 3)]
    row = v.select(kind_of(F.col("v")).alias("whole"), kind_of(get("$.schema", "variant")).alias("schema"), kind_of(get("$.data", "variant")).alias("data"), get("$.tool.name", "string").alias("tool"), get("$.tool.version", "string").alias("version"), F.array(*part).alias("parts")).first()
    if row is None or not row["whole"].startswith("OBJECT"):
        raise InputError("not a JSON object")
    if row["schema"] != "STRING" or row["data"] == "ABSENT":
        raise InputError("no envelope: the version, and so the meaning of a status, is unknown")
    if row["tool"] != tool:
        raise InputError(f"written by {row['tool']}, not by {tool}")
    if None in row["parts"]:
        raise InputError(f"tool.version is {row['version']}, no version")
    if tuple(row["parts"]) < oldest:
        raise InputError(f"version {row['version']} is older than {'.'.join(map(str, oldest))}")
    if not row["data"].startswith("OBJECT"):
        raise InputError("data is no object")


def invalid_entries(entry: DataFrame) -> DataFrame:
    """(name, problem) of entries (name, atom as variant) that the graph gate can't read."""
    get = lambda f: F.try_variant_get("atom", f"$['{f}']", "variant")
    text = lambda f: F.try_variant_get("atom", f"$['{f}']", "string")
    deps = F.try_variant_get("atom", "$.dependencies", "array<string>")
    status, origin = get("verification-status"), get("status-origin")
    told = status.isNotNull() & ~F.is_variant_null(status)
    tests = [
        (~kind_of(F.col("atom")).startswith("OBJECT"), "no object"),
        (get("dependencies").isNotNull() & ~(kind_of(get("dependencies")).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(deps, lambda x: x.isNull()), F.lit(True))), "dependencies"),
        (told & ((kind_of(status) != "STRING") | ~text("verification-status").isin(A.STATUSES)), "verification-status"),
        (origin.isNotNull() & ((kind_of(origin) != "STRING") | (text("status-origin") != ORIGIN)), "status-origin"),
        (origin.isNotNull() & (F.coalesce(text("verification-status"), F.lit("")) != "verified"), "status-origin on another status"),
        (get("kind").isNotNull() & (kind_of(get("kind")) != "STRING"), "kind"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(p)) for t, p in tests]))
    return entry.select("name", F.explode(found).alias("problem"))


def graph_gate(spark: SparkSession, path: str, tool: str) -> dict[str, DataFrame]:
    """Tables ``divergences`` (id, finding), ``missing`` (name, is_member) and ``without_status`` (name) of a document; one that can't be judged raises."""
    check_envelope(spark, path, tool)
    entry = A.entries(spark, path)
    bad = invalid_entries(entry).orderBy("name", "problem").take(1)
    if bad:
        raise InputError(f"{bad[0]['name']}: {bad[0]['problem']}")
    text = lambda f: F.try_variant_get("atom", f"$['{f}']", "string").alias(f.replace("-", "_"))
    atom = entry.select(F.col("name").alias("id"), F.col("name").alias("code_name"), text("kind"), text("verification-status").alias("status"), text("status-origin").alias("origin"), F.try_variant_get("atom", "$.dependencies", "array<string>").alias("deps"))
    n = atom.agg(F.count("*").alias("n"), F.count("status").alias("told"), F.count_if(F.col("status") != "trusted").alias("walked")).first()
    if n["told"] < n["n"] and not n["walked"]:
        raise InputError("no atom has a status of the walk")
    edge = atom.select(F.col("id").alias("src"), F.explode("deps").alias("dst"))
    return {"divergences": graph_divergences(atom, edge), "missing": missing_dependencies(edge, atom), "without_status": atom.where("status IS NULL").select(F.col("id").alias("name"))}


# The header of a report's list, and a listed line.
HEADER = r"^([0-9]+) constant\(s\) rest on an unexcused project sorry:$"
LISTED = r"^(.*?)( \[direct\])?( \[not emitted\])?$"


def parse_report(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed constants (name, direct, emitted) and problems (name, problem) of a report's lines (path, block, place, line).

    The indented lines under the header count, as many as it says; any other line ends
    the list. Flags stand at the end of a line, for a name may hold spaces; of lines
    that list one name the last counts, and so does the last header.
    """
    n = F.regexp_extract("line", HEADER, 1)
    islands = carried(lines, F.when(~F.col("line").startswith("  "), n), "_run").withColumn("_n", n)
    listed = F.col("line").startswith("  ") & (F.coalesce("_run", F.lit("")) != "")
    place = F.struct(*PLACE)
    row = islands.where(listed).select(F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line"), place.alias("at"))
    part = row.select(F.regexp_extract("line", LISTED, 1).alias("name"), (F.regexp_extract("line", LISTED, 2) != "").alias("direct"), (F.regexp_extract("line", LISTED, 3) == "").alias("emitted"), "at")
    names = part.groupBy("name").agg(F.max_by(F.struct("direct", "emitted"), "at").alias("x")).select("name", "x.*")
    said = islands.agg(F.max_by("_n", F.when(F.col("_n") != "", place)).alias("said"), F.count_if(listed).alias("seen"))
    wrong = F.when(F.col("said").isNull(), F.lit("no tainted header")).when(F.col("said").cast("decimal(38,0)") != F.col("seen"), F.concat(F.lit("the header says "), F.col("said"), F.lit(", listed are "), F.col("seen").cast("string")))
    return names, said.select(F.lit("report").alias("name"), wrong.alias("problem")).where("problem IS NOT NULL")


def assumption_problems(atoms: DataFrame, allow_missing: bool = False) -> DataFrame:
    """(name, problem) of assumption lists in atoms (name, status, origin, assumptions): there where a status of the walk is, sorted, without repeats, and with the placeholder where it is reached."""
    held, told = F.col("assumptions").isNotNull(), F.col("status").isNotNull()
    tainted = (F.col("status") == "unverified") | ((F.col("status") == "verified") & (F.col("origin") == ORIGIN))
    no_list = F.when(~told & held, F.lit("assumptions without a status"))
    if allow_missing:
        tests = [no_list, F.when(told & held, F.lit("assumptions though none are expected"))]
    else:
        order = F.when(told & held & (F.array_sort(F.array_distinct("assumptions")) != F.col("assumptions")), F.lit("assumptions unsorted or repeated"))
        tests = [no_list, F.when(told & ~held, F.lit("no assumptions")), order, F.when(told & held & tainted & ~F.array_contains("assumptions", SORRY), F.lit("tainted without the placeholder among its assumptions"))]
    return atoms.select("name", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def status_problems(atoms: DataFrame, listed: DataFrame, allow_missing: bool = False, no_upgrade: bool = False) -> DataFrame:
    """(name, problem) where atoms (name, status, origin) and a report's listed constants (name, direct, emitted) disagree."""
    x = atoms.select("name", "status", "origin", F.lit(True).alias("a")).join(listed.select("name", "direct", "emitted", F.lit(True).alias("l")), "name", "full")
    here, there = F.col("a").isNotNull(), F.col("l").isNotNull()
    direct, status = F.coalesce("direct", F.lit(False)), F.col("status")
    tainted = there & ~direct
    say = lambda test, what: F.when(F.coalesce(test, F.lit(False)), F.lit(what))
    told = here & status.isNotNull()
    tests = [
        say(here & status.isNull() & F.lit(not allow_missing), "no status"),
        say(here & status.isNull() & F.col("origin").isNotNull(), "an origin without a status"),
        say(told & tainted & ~F.col("origin").eqNullSafe(F.lit(ORIGIN)), "listed, but the origin says otherwise"),
        say(told & ~tainted & F.col("origin").isNotNull(), "an origin, but not listed as tainted"),
        say((status == "trusted") & there, "trusted, but listed"),
        say((status == "unverified") & ~(there & direct), "unverified, but not listed as direct"),
        say((status == "verified") & there & direct, "verified, but listed as direct"),
        say((status == "verified") & ~there & F.lit(not no_upgrade), "verified, but not listed"),
        say((status == "transitively-verified") & there, "transitively verified, but listed"),
        say((status == "transitively-verified") & F.lit(no_upgrade), "transitively verified without an upgrade"),
        say(told & ~status.isin("trusted", "unverified", "verified", "transitively-verified"), "an unknown status"),
        say(there & F.col("emitted") & ~here, "listed as shown, but no atom"),
        say(there & ~F.col("emitted") & here, "listed as not shown, but an atom"),
    ]
    return x.select("name", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def status_gate(atoms: DataFrame, report: DataFrame, allow_missing: bool = False, no_upgrade: bool = False) -> DataFrame:
    """(name, problem) over an artifact's atoms and the report's lines (path, block, place, line); empty if both tell the same of every atom."""
    plain = atoms.select(without_prefix(F.col("name")).alias("name"), F.col("`verification-status`").alias("status"), F.col("`status-origin`").alias("origin"), "assumptions")
    listed, problems = parse_report(report)
    return problems.union(assumption_problems(plain, allow_missing)).union(status_problems(plain, listed, allow_missing, no_upgrade))


def in_order(old: Column, new: Column) -> Column:
    """Whether ``old`` is a subsequence of ``new``."""
    after = lambda s: F.slice(new, s["at"] + 1, F.greatest(F.size(new) - s["at"], F.lit(0)))

    def step(s: Column, x: Column) -> Column:
        place = F.array_position(after(s), x).cast("int")
        return F.struct((s["at"] + place).alias("at"), (s["ok"] & (place > 0)).alias("ok"))

    return F.aggregate(old, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), step, lambda s: s["ok"])


def reaches_host(before: DataFrame, hosts: list[str]) -> DataFrame:
    """Names of atoms whose old dependencies lead to one of the hosts, the hosts left out."""
    edge = before.select(F.col("name").alias("src"), F.explode("dependencies").alias("dst")).distinct()
    start = before.where(F.col("name").isin(hosts)).select(F.col("name").alias("id"))
    return reaching(edge, start).where(~F.col("id").isin(hosts)).select(F.col("id").alias("name"))


def compare_artifacts(before: DataFrame, after: DataFrame, policy: str = "fold", hosts: list[str] | None = None, expected: DataFrame | None = None) -> DataFrame:
    """(check, name, detail): what a step that only adds term dependencies must not have done between two artifacts.

    Atoms stay the same, no dependency goes, the other arrays don't change, dependencies
    are the union of both kinds, old arrays are subsequences of the new ones, and
    statuses move only as ``policy`` allows. ``hosts`` are atoms whose status came from
    text that no constant holds: they, and what reached them, may become clean.
    ``expected`` (atom, bucket, target) lists the added dependencies that there must be.
    """
    none = F.array().cast("array<string>")
    fields = sorted({*ARRAYS, *FIXED_ARRAYS})
    side = lambda df, tag: df.select("name", F.lit(True).alias(f"{tag}_is"), *[F.coalesce(F.col(f"`{f}`"), none).alias(f"{tag}_{f}") for f in fields], F.col("`verification-status`").alias(f"{tag}_status"))
    x = side(before, "old").join(side(after, "new"), "name", "full")
    both = F.col("old_is").isNotNull() & F.col("new_is").isNotNull()
    old, new = (lambda f: F.col(f"`old_{f}`")), (lambda f: F.col(f"`new_{f}`"))
    rows = [(F.col("new_is").isNull(), "atom removed", F.lit(None)), (F.col("old_is").isNull(), "atom added", F.lit(None))]
    rows += [(both & (F.size(F.array_except(old(f), new(f))) > 0), "entries removed", F.lit(f)) for f in ARRAYS]
    rows += [(both & (old(f) != new(f)), "array changed", F.lit(f)) for f in FIXED_ARRAYS]
    union = F.array_sort(F.array_union(new("type-dependencies"), new("term-dependencies")))
    rows.append((both & (union != F.array_sort(F.array_distinct(new("dependencies")))), "not the union", F.lit(None)))
    rows += [(both & ~in_order(old(f), new(f)), "not a subsequence", F.lit(f)) for f in ARRAYS]
    a, b = F.coalesce("old_status", F.lit("none")), F.coalesce("new_status", F.lit("none"))
    allowed = reduce(lambda p, q: p | q, [(a == m) & (b == n) for m, n in MOVES[policy]])
    if hosts:
        x = x.join(sized(reaches_host(before, hosts).withColumn("led", F.lit(True))), "name", "left")
        allowed = allowed | ((b == "transitively-verified") & (((a == "unverified") & F.col("name").isin(hosts)) | ((a == "verified") & F.coalesce("led", F.lit(False)))))
    rows.append((both & (a != b) & ~allowed, "status moved", F.concat_ws(" -> ", a, b)))
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(c).alias("check"), d.cast("string").alias("detail"))) for t, c, d in rows]))
    out = x.select("name", F.explode(found).alias("v")).select("v.check", "name", "v.detail")
    if hosts:
        known = before.select("name")
        named = before.sparkSession.createDataFrame([(h,) for h in hosts], "name string")
        out = out.union(named.join(sized(known), "name", "left_anti").select(F.lit("unknown host"), "name", F.lit(None).cast("string")))
    if expected is not None:
        got, want = added_dependencies(before, after), expected.select("atom", "bucket", "target").distinct()
        told = lambda df, check: df.select(F.lit(check), F.concat(F.lit("probe:"), "atom"), F.concat_ws(" ", "bucket", "target"))
        out = out.union(told(want.exceptAll(got), "predicted but not added")).union(told(got.exceptAll(want), "added but not predicted"))
    return out


def added_dependencies(before: DataFrame, after: DataFrame) -> DataFrame:
    """(atom, bucket, target): type and term dependencies that only ``after`` has, names without prefix, for atoms of both."""
    def side(df: DataFrame) -> DataFrame:
        rows = [df.select("name", F.lit(k).alias("bucket"), F.explode(F.col(f"`{k}-dependencies`")).alias("target")) for k in ("type", "term")]
        return rows[0].union(rows[1]).select(without_prefix(F.col("name")).alias("atom"), "bucket", without_prefix(F.col("target")).alias("target")).distinct()

    old = before.select(without_prefix(F.col("name")).alias("atom"))
    return side(after).join(sized(old), "atom", "left_semi").join(sized(side(before)), ["atom", "bucket", "target"], "left_anti")


def comparison_notes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(note, n): added dependencies and the atoms they belong to, atoms that nothing used before, repeats and unsorted arrays, and what else differs."""
    added = added_dependencies(before, after)
    count = lambda df, note: df.select(F.lit(note).alias("note")).groupBy("note").agg(F.count("*").alias("n"))
    uses = lambda df: df.select("name", F.explode("dependencies").alias("dst")).where("name <> dst").select(F.col("dst").alias("name")).distinct()
    common = before.select("name").join(after.select("name"), "name", "left_semi")
    found = [count(added, "added"), count(added.select("atom").distinct(), "atoms with added"), count(common.join(uses(after), "name", "left_semi").join(uses(before), "name", "left_anti"), "used at last")]
    for tag, df in (("before", before), ("after", after)):
        each = df.join(common, "name", "left_semi").select("name", F.explode(F.array(*[F.col(f"`{f}`") for f in ARRAYS])).alias("x"))
        found += [count(each.where(F.array_sort("x") != F.col("x")), f"unsorted {tag}"), count(each.where(F.size(F.array_distinct("x")) < F.size("x")), f"with repeats {tag}")]
    pair = before.alias("b").join(after.alias("a"), "name")
    for f in ("attributes", "specs", "primary-spec", "assumptions", "verification-status"):
        found.append(count(pair.where(~F.col(f"b.`{f}`").eqNullSafe(F.col(f"a.`{f}`"))), f"{f} changed"))
    return reduce(DataFrame.union, found)


def seeds(atoms: DataFrame) -> DataFrame:
    """Names of atoms from which the graph gate starts."""
    return atoms.where(F.col("`verification-status`").isin(SEEDS)).select("name")
