"""Gates and comparisons over graphs that are already published: violations come back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.names import is_realised_theorem
from lemmaflow.operators.graph import merge_classes
from lemmaflow.plans.fixpoint import reaching
from lemmaflow.plans.scratch import sized

# Statuses and kinds that the gates look at.
SEEDS = ["unverified", "failed"]
PASSES = ["verified", "transitively-verified"]
TYPE_KINDS = ["inductive", "structure", "class"]


def missing_dependencies(edge: DataFrame, atom: DataFrame) -> DataFrame:
    """(name, is_member): names that edges (src, dst) use and no atom (code_name, kind) has; members of a known type are told apart."""
    lost = edge.select(F.col("dst").alias("name")).distinct().join(atom.select(F.col("code_name").alias("name")), "name", "left_anti")
    types = atom.where(F.col("kind").isin(TYPE_KINDS)).select(F.col("code_name").alias("parent"), F.lit(True).alias("m")).distinct()
    lost = lost.withColumn("parent", F.regexp_replace("name", r"\.[^.]*$", ""))
    return lost.join(types, "parent", "left").select("name", F.coalesce("m", F.lit(False)).alias("is_member"))


def graph_divergences(status: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, finding) of ``status`` (id, status, origin): atoms called clean that reach a failure, and tainted ones that reach none.

    Reaching runs backwards from unverified or failed atoms through callers that are
    verified in either way. Clean is what is transitively verified, or verified without
    an origin; tainted what is verified with one.
    """
    passes = status.where(F.col("status").isin(PASSES)).select(F.col("id").alias("src"))
    usable = edge.select("src", "dst").distinct().join(sized(passes), "src", "left_semi")
    hit = reaching(usable, status.where(F.col("status").isin(SEEDS)).select("id")).withColumn("hit", F.lit(True))
    x = status.join(sized(hit), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    tainted = (F.col("status") == "verified") & F.col("origin").isNotNull()
    finding = F.when(F.col("status").isin(PASSES) & ~tainted & F.col("hit"), F.lit("reaches a failure")).when(tainted & ~F.col("hit"), F.lit("reaches none"))
    return x.select("id", finding.alias("finding")).where("finding IS NOT NULL")


def status_consistency(artifact: DataFrame, report: DataFrame) -> DataFrame:
    """(id, in_artifact, in_report) where two tables (id, status) disagree."""
    a, b = artifact.select("id", F.col("status").alias("in_artifact")), report.select("id", F.col("status").alias("in_report"))
    return a.join(b, "id", "full").where(~F.col("in_artifact").eqNullSafe(F.col("in_report")))


def artifact_diff(old: DataFrame, new: DataFrame, moves: list[tuple[str, str]]) -> DataFrame:
    """(id, change, allowed) between two artifacts (id, status): atoms that came or went, and statuses that moved."""
    x = old.select("id", F.col("status").alias("a"), F.lit(1).alias("o")).join(new.select("id", F.col("status").alias("b"), F.lit(1).alias("n")), "id", "full")
    change = F.when(F.col("o").isNull(), F.lit("added")).when(F.col("n").isNull(), F.lit("removed")).when(~F.col("a").eqNullSafe(F.col("b")), F.concat_ws("->", F.coalesce("a", F.lit("none")), F.coalesce("b", F.lit("none"))))
    return x.select("id", change.alias("change")).where("change IS NOT NULL").withColumn("allowed", F.col("change").isin([f"{a}->{b}" for a, b in moves]))


def in_degree_rescue(edge: DataFrame, added: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, n): atoms that nothing referenced before the added edges, and how many reference them now."""
    visible = lambda e: e.select("src", "dst").distinct().join(shown.select(F.col("id").alias("src")), "src", "left_semi")
    fresh = visible(added).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return fresh.join(visible(edge).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


# Shapes of auxiliary names by their last part, in the order in which they are tried.
SHAPES = [("_proof_N", r"^_?proof_"), ("match_N", r"^_?match_"), ("_cstage", r"^_cstage"), (".mk", r"^mk$"), (".casesOn/.rec*", r"^(casesOn|recOn|brecOn|rec|binductionOn)$"), (".noConfusion*", r"^(noConfusion|noConfusionType)$"), (".injEq/.inj", r"^(injEq|inj|sizeOf_spec)$"), (".eq_def", r"^eq_def$"), (".eq_N", r"^eq_[0-9]*$")]


def name_shape(last: Column) -> Column:
    """The shape of an auxiliary's last name part; numbers at its end don't count."""
    bare = F.regexp_replace(last, "[0-9]+$", "")
    out = F.when(last.rlike(SHAPES[0][1]), SHAPES[0][0])
    for shape, pattern in SHAPES[1:]:
        out = out.when(last.rlike(pattern), shape)
    return out.when(last.startswith("_"), F.concat(F.lit("other _prefixed ("), bare, F.lit(")"))).otherwise(F.concat(F.lit("other ("), bare, F.lit(")")))


def shape_histogram(edge: DataFrame, decl: DataFrame, closure: DataFrame, hosts: DataFrame) -> DataFrame:
    """(shape, n, n_hidden, n_hosts) of auxiliaries that hosts use: uses, edges hidden behind them, and hosts that lose any.

    ``decl`` has (id, name, aux), ``closure`` (src, dst) what an auxiliary leads to,
    ``hosts`` (id). What a host uses anyway, and the host itself, isn't hidden.
    """
    direct = edge.select("src", "dst").distinct().join(hosts.select(F.col("id").alias("src")), "src", "left_semi")
    aux = decl.where("aux").select(F.col("id").alias("dst"), name_shape(F.element_at(F.split("name", r"\."), -1)).alias("shape"))
    used = direct.join(aux, "dst").select("src", F.col("dst").alias("aux"), "shape")
    hidden = used.join(closure.select(F.col("src").alias("aux"), "dst"), "aux").where("src <> dst").join(direct, ["src", "dst"], "left_anti")
    counts = hidden.groupBy("shape").agg(F.count("*").alias("n_hidden"), F.count_distinct("src").alias("n_hosts"))
    return used.groupBy("shape").agg(F.count("*").alias("n")).join(counts, "shape", "left").select("shape", "n", F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"), F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"))


def proof_carriers(edge: DataFrame, decl: DataFrame, proofs: DataFrame) -> DataFrame:
    """(n_decls, n_carriers): declarations that are no theorems, and those among them that use a proof auxiliary (``proofs``: id)."""
    plain = decl.where("kind <> 'theorem'").select(F.col("id").alias("src"))
    carriers = edge.join(plain, "src", "left_semi").join(proofs.select(F.col("id").alias("dst")), "dst", "left_semi").select("src").distinct().withColumn("c", F.lit(True))
    return plain.join(carriers, "src", "left").agg(F.count("*").alias("n_decls"), F.count("c").alias("n_carriers"))


def hidden_by_position(edge: DataFrame, closure: DataFrame, hosts: DataFrame) -> DataFrame:
    """(role, n_uses, n_hidden): for types and values apart, how often hosts use auxiliaries, and the edges these hide."""
    own = edge.join(hosts.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "role").distinct()
    aux = closure.select(F.col("src").alias("aux")).distinct()
    used = own.withColumnRenamed("dst", "aux").join(aux, "aux", "left_semi")
    seen = own.select("src", "dst", F.lit(True).alias("in_type")).where("role = 'type'").union(own.select("src", "dst", F.lit(False).alias("in_type"))).distinct()
    lost = used.join(closure.select(F.col("src").alias("aux"), "dst"), "aux").where("src <> dst").select("src", "dst", "role", (F.col("role") == "type").alias("in_type")).distinct().join(seen, ["src", "dst", "in_type"], "left_anti")
    return used.groupBy("role").agg(F.count("*").alias("n_uses")).join(lost.groupBy("role").agg(F.count("*").alias("n_hidden")), "role", "left").select("role", "n_uses", F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"))


#: Names that a note lists.
MOST_LISTED = 10


def listings(found: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """(note, n, names) of ``found`` (note, name): how many names a note has, and the first ``most`` of them in order, with what is left out counted.

    Only the first names of each task's share travel, so a note may have any number.
    """
    rows = found.where("name IS NOT NULL").distinct()
    order = Window.partitionBy("note").orderBy("name")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    shown = first.groupBy("note").agg(F.array_sort(F.collect_list("name")).alias("shown"))
    counts = rows.groupBy("note").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(", … and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return counts.join(shown, "note").select("note", "n", F.concat(F.array_join("shown", ", "), more).alias("names"))


def run_notes(version: DataFrame, generated: DataFrame, ambiguous: DataFrame, roots: DataFrame, duplicates: DataFrame, collisions: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """One table of what a run has to say: (note, n, names).

    ``version`` (name, module, in_project) gives names that modules share, told apart by
    whether the compiler made them; the others have one column ``name`` each.
    """
    classes = merge_classes(version)
    kind = F.when(F.col("class") == "cross", F.lit("declared outside too")).when(is_realised_theorem(F.col("name")), F.lit("realised in several modules")).otherwise(F.lit("declared in several modules"))
    found = classes.select(kind.alias("note"), "name")
    for note, names in (("generated axioms", generated), ("several primary specifications", ambiguous), ("trusted roots", roots), ("repeated names", duplicates), ("colliding names", collisions)):
        found = found.union(names.select(F.lit(note).alias("note"), F.col("name").cast("string").alias("name")))
    return listings(found, most)
