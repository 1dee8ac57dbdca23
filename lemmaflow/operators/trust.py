"""Trust, taint and verification status of declarations.

Tables: ``decl`` (id, kind, in_project, tagged, module_external, type_is_prop, ...) and
``edge`` (src, dst, role), where role is ``type``, ``ctor`` or ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.plans.fixpoint import label_counts, labels_reaching, reaching
from lemmaflow.plans.scratch import sized, written

SORRY = "sorryAx"

# The axioms every development may use, and those of the compiler.
STANDARD_AXIOMS = ["propext", "Classical.choice", "Quot.sound"]
COMPILER_AXIOMS = ["Lean.ofReduceBool", "Lean.ofReduceNat", "Lean.trustCompiler"]

# Report categories in report order.
CATEGORY_ORDER = ["sorry", "bv_decide", "native_decide", "universe-typed", "project axiom", "dependency axiom", "trusted"]


def trusted_reason(kind: Column, tagged: Column, module_external: Column, type_is_prop: Column) -> Column:
    """Why a declaration is trusted: it is an axiom, carries the tag, or is data from an external module; null if it isn't.

    Whether a type is a proposition may be undecided (null); then it counts as a proof.
    """
    proof = F.coalesce(type_is_prop, F.lit(True))
    return F.when(kind == "axiom", F.lit("axiom")).when(tagged, F.lit("externally_verified")).when(module_external & ~proof, F.lit("external"))


def trust_base(decl: DataFrame) -> DataFrame:
    """(id, reason) of trusted project declarations."""
    reason = trusted_reason(F.col("kind"), F.col("tagged"), F.col("module_external"), F.col("type_is_prop"))
    return decl.where("in_project").select("id", reason.alias("reason")).where("reason IS NOT NULL")


def merged_trust(versions: DataFrame) -> DataFrame:
    """(id, reason) for names with several versions (id, module, kind, module_external, type_is_prop): trusted if every version is, by rules 1 or 3; the reason is the first module's."""
    reason = trusted_reason(F.col("kind"), F.lit(False), F.col("module_external"), F.col("type_is_prop"))
    judged = versions.withColumn("reason", reason)
    out = judged.groupBy("id").agg(F.bool_and(F.col("reason").isNotNull()).alias("every"), F.min_by("reason", "module").alias("reason"))
    return out.where("every").select("id", "reason")


def generated_axioms(trusted: DataFrame, decl: DataFrame) -> DataFrame:
    """Trusted axioms that no one can see in the source: internal names, and those without lines (decl: id, is_visible)."""
    return trusted.where("reason = 'axiom'").join(sized(decl.where("NOT is_visible").select("id")), "id", "left_semi").select("id")


def walk_edges(edge: DataFrame, decl: DataFrame, trusted: DataFrame) -> DataFrame:
    """(src, dst, role) that the status walk follows: sources in the project; of trusted ones the statement alone."""
    inside = edge.join(sized(decl.where("in_project").select(F.col("id").alias("src"))), "src", "left_semi")
    flagged = inside.join(sized(trusted.select(F.col("id").alias("src"), F.lit(True).alias("is_trusted"))), "src", "left")
    return flagged.where("is_trusted IS NULL OR role <> 'value'").select("src", "dst", "role")


def statement_edges(edge: DataFrame) -> DataFrame:
    return edge.where("role IN ('type', 'ctor')").select("src", "dst").distinct()


def proof_edges(edge: DataFrame) -> DataFrame:
    return edge.where("role = 'value'").select("src", "dst").distinct()


def direct_carriers(walk: DataFrame, sorry) -> DataFrame:
    """Ids with an edge to the placeholder for missing proofs."""
    return walk.where(F.col("dst") == F.lit(sorry)).select(F.col("src").alias("id")).distinct()


def tainted(walk: DataFrame, sorry) -> DataFrame:
    """Ids from which the placeholder can be reached."""
    direct = direct_carriers(walk, sorry)
    return reaching(walk.where(F.col("dst") != F.lit(sorry)).select("src", "dst"), direct)


def verdicts(decl: DataFrame, trusted: DataFrame, taint: DataFrame, direct: DataFrame) -> DataFrame:
    """(id, verdict, reason): none outside the project; then direct, tainted, trusted, clean, in that order."""
    flag = lambda df, name: sized(df.select("id", F.lit(True).alias(name)))
    x = decl.select("id", "in_project").join(sized(trusted), "id", "left").join(flag(taint, "t"), "id", "left").join(flag(direct, "d"), "id", "left")
    verdict = F.when(~F.col("in_project"), F.lit(None)).when(F.col("d"), F.lit("direct")).when(F.col("t"), F.lit("tainted")).when(F.col("reason").isNotNull(), F.lit("trusted")).otherwise(F.lit("clean"))
    return x.select("id", verdict.alias("verdict"), F.when(verdict == "trusted", F.col("reason")).alias("reason"))


def stamped(verdict: DataFrame, skip_enrich: bool = False, skip_verify: bool = False) -> DataFrame:
    """(id, status, reason, origin) in one of the three modes."""
    v = F.col("verdict")
    if skip_verify:
        status, origin = F.when(v == "trusted", F.lit("trusted")), F.lit(None).cast("string")
    else:
        clean = "verified" if skip_enrich else "transitively-verified"
        status = F.when(v == "trusted", F.lit("trusted")).when(v == "direct", F.lit("unverified")).when(v == "tainted", F.lit("verified")).when(v == "clean", F.lit(clean))
        origin = F.when(v == "tainted", F.lit("kernel-taint"))
    return verdict.select("id", status.alias("status"), "reason", origin.alias("origin"))


def status_counts(status: DataFrame) -> DataFrame:
    """How many are transitively verified, verified locally, and neither."""
    s = F.coalesce("status", F.lit(""))
    return status.agg(F.count_if(s == "transitively-verified").alias("n_transitive"), F.count_if(s == "verified").alias("n_local"), F.count_if(~s.isin("transitively-verified", "verified")).alias("n_other"))


def unhidden(atoms: DataFrame) -> DataFrame:
    """``atoms`` where a hidden generated one that carries bad news shows after all."""
    generated = F.col("is_lean_generated") | F.col("is_aeneas_generated")
    bad = F.coalesce(F.col("status").isin("verified", "unverified", "failed"), F.lit(False))
    return atoms.withColumn("is_hidden", F.col("is_hidden") & ~(generated & bad))


def resting(decl: DataFrame, edge: DataFrame, trusted: DataFrame, sorry, standard: list, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What assumptions follow from: edges (src, dst), labels (id, label) where they begin but for the placeholder, and the nodes (id) that rest on the placeholder.

    The placeholder and axioms hold themselves. The three standard axioms outside the
    project hold nothing. A trusted node follows statement and proof, but a placeholder
    met through its proof is its own to vouch for: the label becomes the node. That
    rewrite happens in a known place, so it splits into plain reachability: first who
    reaches the placeholder without crossing a trusted proof, then all labels at once.
    ``extra`` has edges of versions outside the project, which no trust excuses.
    """
    known = decl.join(sized(trusted.select("id", F.lit(True).alias("trusted"))), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    quiet = (F.col("id").isin(standard) if standard else F.lit(False)) & ~F.col("in_project")
    shown = known.withColumn("quiet", quiet)
    axiom = (F.col("kind") == "axiom") & ~F.col("quiet")
    if "axiom_version" in decl.columns:
        axiom = axiom | (F.coalesce("axiom_version", F.lit(False)) & ~F.col("quiet"))
    own = shown.where(axiom & (F.col("id") != F.lit(sorry))).select("id", F.col("id").alias("label"))
    facts = shown.select(F.col("id").alias("src"), "kind", "quiet", "in_project", "trusted")
    usable = edge.join(sized(facts), "src").where((F.col("src") != F.lit(sorry)) & ~F.col("quiet")).where("role <> 'value' OR kind <> 'axiom'")
    usable = usable.withColumn("vouches", F.col("trusted") & (F.col("role") == "value"))
    if extra is not None:
        usable = usable.select("src", "dst", "vouches").union(extra.select("src", "dst", F.lit(False)))
    usable = written(usable.select("src", "dst", "vouches").distinct(), "usable")
    source = decl.sparkSession.range(1).select(F.lit(sorry).alias("id"))
    shaken = reaching(usable.where("NOT vouches").select("src", "dst"), source)
    vouched = usable.where("vouches").join(sized(shaken.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    return usable.select("src", "dst"), own.union(vouched), shaken


def assumption_pairs(decl: DataFrame, edge: DataFrame, trusted: DataFrame, sorry, standard: list, extra: DataFrame | None = None) -> DataFrame:
    """(id, label), each once: what each node rests on, by the rules of ``resting``."""
    usable, own, shaken = resting(decl, edge, trusted, sorry, standard, extra)
    return labels_reaching(usable, own).union(shaken.select("id", F.lit(sorry).alias("label")))


def assumption_holders(decl: DataFrame, edge: DataFrame, trusted: DataFrame, sorry, standard: list, extra: DataFrame | None = None) -> DataFrame:
    """(label, n): how many project declarations hold each label of ``assumption_pairs``, without the pairs."""
    usable, own, shaken = resting(decl, edge, trusted, sorry, standard, extra)
    project = decl.where("in_project").select("id")
    on_sorry = shaken.join(sized(project), "id", "left_semi").agg(F.lit(sorry).alias("label"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return label_counts(usable, own, project).union(on_sorry)


def labels_in_use(decl: DataFrame, edge: DataFrame, trusted: DataFrame, sorry, standard: list, extra: DataFrame | None = None) -> DataFrame:
    """(label): labels of ``assumption_pairs`` that any project declaration holds.

    Such a label begins at a node that the project reaches, which one flag a node tells.
    What lies in the project is reached already, so only edges out of it and beyond are walked.
    """
    usable, own, shaken = resting(decl, edge, trusted, sorry, standard, extra)
    project = decl.where("in_project").select("id")
    outer = written(usable.join(sized(project.select(F.col("id").alias("dst"))), "dst", "left_anti").select("src", "dst"), "outer")
    leaving = outer.select(F.col("src").alias("id")).distinct().join(sized(project), "id", "left_semi")
    reached = reaching(outer.select(F.col("dst").alias("src"), F.col("src").alias("dst")), leaving)
    on_sorry = shaken.join(sized(project), "id", "left_semi").select(F.lit(sorry).alias("label")).distinct()
    return own.join(sized(project.union(reached).distinct()), "id", "left_semi").select("label").distinct().union(on_sorry)


def assumption_category(label: DataFrame, sorry, standard: list, compiler: list) -> DataFrame:
    """(id, category) for labels given as declarations (id, kind, in_project, is_bv_decide, is_native, is_universe_typed, axiom_version, reason)."""
    owner = F.when(F.col("in_project"), F.lit("project axiom")).otherwise(F.lit("dependency axiom"))
    native = F.col("is_native") | (F.col("id").isin(compiler) if compiler else F.lit(False))
    axiom = F.when(F.col("is_bv_decide"), F.lit("bv_decide")).when(native, F.lit("native_decide")).when(F.col("is_universe_typed"), F.lit("universe-typed")).otherwise(owner)
    category = F.when(F.col("id") == F.lit(sorry), F.lit("sorry")).when(F.col("kind") == "axiom", axiom).when(F.col("axiom_version"), owner).when(F.col("reason").isNotNull(), F.concat(F.lit("trusted ("), F.col("reason"), F.lit(")"))).otherwise(F.lit("unknown"))
    return label.select("id", category.alias("category"))


def assumption_report(held: DataFrame, categories: DataFrame) -> DataFrame:
    """``held`` (label, and how many project declarations hold it) with the category of each label."""
    return held.join(sized(categories.select(F.col("id").alias("label"), "category")), "label")


def category_counts(report: DataFrame) -> DataFrame:
    """(place, category, n_labels): labels in use by category, zeros included, in report order."""
    spark = report.sparkSession
    order = spark.sql("SELECT place, category FROM VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CATEGORY_ORDER)) + " AS t(place, category)")
    group = F.when(F.col("category").startswith("trusted"), F.lit("trusted")).otherwise(F.col("category"))
    counts = report.select(group.alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return order.join(counts, "category", "left").select("place", "category", F.coalesce("n", F.lit(0)).alias("n_labels"))
