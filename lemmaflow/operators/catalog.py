"""Every operator over the derived tables, by name, with the same question as SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import names as N
from lemmaflow.functions.lexer import strip_sources, stripped
from lemmaflow.operators import audit as A
from lemmaflow.operators import commands, gates
from lemmaflow.operators import graph as G
from lemmaflow.operators import headers as H
from lemmaflow.operators import trust as T
from lemmaflow.operators.commands import Dump
from lemmaflow.plans.scratch import shared_folder, sized, written
from lemmaflow.sources import derived as D
from lemmaflow.sources.artifact import entries, write_document
from lemmaflow.sources.tables import table


class Graph:
    """The derived tables of one folder, and what follows from them, each built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.decl = D.derived(spark, folder, D.DECL)
        self.trusted = T.trust_base(self.decl)

    @property
    def edge(self) -> DataFrame:
        return D.derived(self.spark, self.folder, D.EDGE)

    @property
    def version(self) -> DataFrame:
        return D.derived(self.spark, self.folder, D.VERSION)

    @property
    def module(self) -> DataFrame:
        return D.derived(self.spark, self.folder, D.MODULE)

    @property
    def imports(self) -> DataFrame:
        return D.derived(self.spark, self.folder, D.IMPORT)

    def ids(self, condition: str) -> DataFrame:
        return self.decl.where(condition).select("id")

    def walk(self) -> DataFrame:
        return T.walk_edges(self.edge, self.decl, self.trusted)

    def verdicts(self) -> DataFrame:
        walk = written(self.walk(), "walk")
        return T.verdicts(self.decl, self.trusted, T.tainted(walk, D.SORRY), T.direct_carriers(walk, D.SORRY))

    def status(self, **mode) -> DataFrame:
        return T.stamped(self.verdicts(), **mode)

    def assumptions(self, operator: Callable[..., DataFrame]) -> DataFrame:
        return operator(self.decl, self.edge, self.trusted, D.SORRY, D.STANDARD)

    def report(self, held: DataFrame) -> DataFrame:
        spark = self.spark
        label = self.decl.join(sized(self.trusted), "id", "left").select("id", "kind", "in_project", F.col("known_attribute").alias("is_bv_decide"), F.col("is_aeneas_generated").alias("is_native"), F.col("carrier").alias("is_universe_typed"), F.lit(False).alias("axiom_version"), "reason")
        sorry = spark.sql(f"SELECT cast({D.SORRY} AS bigint) AS id, 'axiom' AS kind, false AS in_project, false AS is_bv_decide, false AS is_native, false AS is_universe_typed, false AS axiom_version, cast(null AS string) AS reason")
        return T.assumption_report(held, T.assumption_category(label.union(sorry), D.SORRY, D.STANDARD, []))

    def closure(self) -> DataFrame:
        return G.fold_closure(self.edge, self.ids("aux AND kind <> 'axiom'"), self.ids("NOT aux"))

    def folded(self) -> DataFrame:
        return G.folded_edges(self.edge, self.closure(), self.ids("NOT aux"))

    def atoms(self) -> DataFrame:
        attributes = F.when(F.col("known_attribute"), F.array(F.lit("step"))).otherwise(F.array().cast("array<string>"))
        return self.decl.select(
            "*", attributes.alias("attributes"), F.lit(None).cast("string").alias("step_program_head"), F.col("type_is_prop").alias("is_proof"), F.lit(False).alias("codomain_is_prop"), (F.col("kind") == "structure").alias("codomain_is_type")
        )

    def specs(self) -> DataFrame:
        edge = self.edge
        return G.specs(self.atoms(), edge.where("role = 'type'"), edge)


def flags(g: Graph) -> dict:
    col = F.col
    return {"is_instance": col("is_aeneas_generated"), "is_projection": col("known_attribute"), "is_abbrev": col("carrier"), "is_class": col("tagged"), "is_structure": col("aux")}


def import_closure(g: Graph) -> DataFrame:
    return G.import_closure(g.module, g.imports, g.module.where("is_target").select("module"))


def ownership(g: Graph) -> DataFrame:
    owner = g.module.select("module", F.when(F.col("s_nationkey") % 3 == 0, F.lit("lib")).alias("lib"), F.when(F.col("s_nationkey") % 4 == 0, F.lit("exe")).alias("exe"))
    return G.ownership(owner, g.imports.select(F.col("imported").alias("module")).distinct(), g.module.where("is_target"))


def emitted_modules(g: Graph) -> DataFrame:
    return G.emitted_modules(g.module.where("in_build_dir"), import_closure(g), g.module.where("s_nationkey % 3 = 0"), narrow=False)


def owners_exact_cover(g: Graph) -> DataFrame:
    answered = g.module.where("s_nationkey <> 3").union(g.module.where("s_nationkey = 4"))
    return G.owners_exact_cover(g.module.select("module"), answered.select("module"))


def coimport_collisions(g: Graph) -> DataFrame:
    v = g.version.withColumn("level_params", F.array().cast("array<string>")).withColumn("all_names", F.array("name"))
    return G.coimport_collisions(v)


def report_status(g: Graph, status: DataFrame | None = None) -> DataFrame:
    """The status table again as another tool could report it: some statuses differ, some rows are absent."""
    return (status or g.status()).withColumn("status", F.when(F.col("id") % 50 == 0, F.lit("failed")).otherwise(F.col("status"))).where("id % 77 <> 0")


def two_reports(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The status table, walked and written once, and the other tool's report of it."""
    status = written(g.status(), "status")
    return status, report_status(g, status)


def missing(g: Graph) -> DataFrame:
    shown = g.decl.where("NOT aux")
    named = g.edge.join(g.decl.select(F.col("id").alias("dst"), "code_name"), "dst").select("src", F.col("code_name").alias("dst"))
    return A.missing_dependencies(named, shown)


def source_lines(g: Graph) -> DataFrame:
    """(path, line_no, text): three lines for each declaration, in which what looks like an attribute may stand in a comment, a string or a body."""
    short = N.last_part(F.col("name"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    first = ["@[simp, local step 10]", "/-- not @[fake] -/ @[ext]", "-- @[fake]", "@[externally_verified]", "private noncomputable", "@[externally_verified, step] def elsewhere := 1"]
    second = [say("theorem ", short, " : T"), say("def ", short, ' := "@[fake]"'), say("@[externally_verified, progress] private theorem ", short, " : T"), F.lit("instance : Foo"), F.lit("theorem other_name : T"), say("@[fake] def ", short)]
    at = (F.col("id") % 6).cast("int")
    texts = F.array(F.get(F.array(*map(F.lit, first)), at), F.get(F.array(*second), at), F.lit("  @[fake] exact x"))
    lines = g.decl.select("id", F.col("code_path").alias("path"), F.posexplode(texts).alias("k", "text"))
    return lines.select("path", (4 * F.col("id") + 1 + F.col("k")).alias("line_no"), "text")


def scanned_attributes(g: Graph) -> tuple[DataFrame, DataFrame]:
    code = written(strip_sources(source_lines(g)), "code")
    decl = g.decl.select("id", "name", F.col("code_path").alias("path"), (4 * F.col("id") + 1).alias("range_start"), (4 * F.col("id") + 3).alias("range_end"), (F.col("id") % 12 == 3).alias("is_instance"), "tagged", F.col("is_primary_spec").alias("primary_spec_tag"), F.col("known_attribute").alias("is_projection"))
    return decl, H.declared_attributes(decl, H.scan_headers(decl, code))


def attribute_scan(g: Graph) -> DataFrame:
    return scanned_attributes(g)[1].select("id", F.array_join("attributes", ",").alias("attributes"), "shows_tag", "names_tag")


def head_lines(g: Graph) -> DataFrame:
    return strip_sources(source_lines(g)).select("path", "line_no", N.is_head_line(F.col("code")).alias("is_head"), N.without_attributes(F.col("code")).alias("rest"))


def fold_classes(g: Graph) -> DataFrame:
    names = g.edge.select(F.col("dst").alias("id")).union(g.edge.where("src % 10 = 3").select((F.col("src") + 10**9).alias("id")))
    constant = g.decl.select("id", "name", "in_project", F.col("lines_start").isNotNull().alias("has_range"), "ctor_kind")
    return G.fold_classes(names, constant)


def fixpoint_bodies(g: Graph) -> DataFrame:
    base = F.concat(F.lit("f"), F.col("id").cast("string"))
    name = F.when(F.col("id") % 4 == 0, F.concat(base, F.lit(".mutual"))).otherwise(base)
    return G.fixpoint_bodies(g.decl.select("id", name.alias("name"), "in_project", (F.col("id") % 16 == 0).alias("is_shown"), F.when(F.col("id") % 8 == 0, base).alias("fixpoint_body_of")))


def companion_heads(g: Graph) -> DataFrame:
    odd = F.col("id") % 2 == 1
    name = F.when(odd, F.concat(F.lit("N"), (F.col("id") - 1).cast("string"), F.lit(".mvcgen_spec"))).otherwise(F.concat(F.lit("N"), F.col("id").cast("string")))
    head = F.when(F.col("ctor_kind") == "axiom", F.concat(F.lit("H"), F.col("id").cast("string")))
    return G.companion_heads(g.decl.select("id", name.alias("name"), "ctor_kind", head.alias("step_program_head"))).select("id", "step_program_head")


def specified(g: Graph) -> tuple[DataFrame, DataFrame]:
    atom = D.derived(g.spark, g.folder, D.SPEC_ATOM).select("id", "name", F.array("attribute").alias("attributes"), F.col("head").alias("step_program_head"), "is_primary_spec")
    return D.derived(g.spark, g.folder, D.SPEC_RELATION), atom


def closure_problems(g: Graph) -> DataFrame:
    return G.closure_problems(g.module.where("s_nationkey <> 3"), g.imports, g.module.where("is_target").select("module"))


def example_modules(g: Graph) -> DataFrame:
    module = F.when(F.col("type_hash").isin("h1", "h2"), F.concat("module", F.lit(".Sub"))).otherwise(F.col("module"))
    return G.example_module(g.version.select("name", module.alias("module")).distinct())


def artifacts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The same atoms before and after folding, with mistakes planted in the later ones."""
    ref = lambda c: F.concat(F.lit("probe:"), F.col(c).cast("string"))
    pick = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, ref("dst"))))
    arrays = g.edge.groupBy(F.col("src").alias("id")).agg(pick("type").alias("t"), pick("value").alias("v"))
    none = F.array().cast("array<string>")
    base = g.decl.where("NOT aux").select("id").join(sized(arrays), "id", "left").select("id", F.coalesce("t", none).alias("t"), F.coalesce("v", none).alias("v"))
    more = g.folded().groupBy(F.col("src").alias("id")).agg(F.collect_set(ref("dst")).alias("f"))
    fresh = base.join(sized(more), "id", "left").withColumn("t", F.when(F.col("id") % 50 == 0, F.array_append("t", F.lit("probe:zz"))).otherwise(F.col("t")))
    fresh = fresh.withColumn("v", F.array_sort(F.array_union("v", F.coalesce("f", none)))).withColumn("v", F.when(F.col("id") % 60 == 1, F.slice("v", 2, 1 << 30)).otherwise(F.col("v")))

    def shaped(df: DataFrame, status: DataFrame, cut) -> DataFrame:
        deps = F.array_sort(F.array_union("t", "v"))
        x = df.join(sized(status.select("id", "status")), "id").withColumn("d", deps).withColumn("d", F.when(cut, F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0)))).otherwise(F.col("d")))
        return x.select(ref("id").alias("name"), F.col("d").alias("dependencies"), F.col("t").alias("type-dependencies"), F.col("v").alias("term-dependencies"), none.alias("type-dependencies-external"), none.alias("term-dependencies-external"), F.col("status").alias("verification-status"))

    status = written(g.status(), "status")
    return shaped(base, status, F.lit(False)), shaped(fresh, report_status(g, status), F.col("id") % 70 == 2)


def status_report(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Atoms with statuses, and another report's list of tainted constants with rows gone and rows too many."""
    verdict = written(g.verdicts(), "verdict")
    atoms = T.stamped(verdict).join(sized(g.ids("NOT aux")), "id").select(F.col("id").cast("string").alias("name"), "status", "origin")
    bad = verdict.where("verdict IN ('direct', 'tainted') AND id % 31 <> 0").select("id", (F.col("verdict") == "direct").alias("direct"))
    extra = g.decl.where("id % 37 = 5").select("id", F.lit(True).alias("direct")).join(sized(bad.select("id")), "id", "left_anti")
    listed = bad.union(extra).join(sized(g.decl.select("id", (~F.col("aux")).alias("emitted"))), "id")
    return atoms, listed.select(F.col("id").cast("string").alias("name"), "direct", (F.col("emitted") & (F.col("id") % 41 != 0)).alias("emitted"))


def assumption_problems(g: Graph) -> DataFrame:
    """Assumption lists with the placeholder missing, repeats, and lists without a status."""
    held = g.status().withColumn("assumptions", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.array(F.lit("b"), F.lit("a"))).when(F.col("id") % 5 == 2, F.array(F.lit("a"), F.lit("sorryAx"))).otherwise(F.array().cast("array<string>")))
    return gates.assumption_problems(held.select(F.col("id").alias("name"), "status", "origin", "assumptions"))


def status_gate(g: Graph) -> DataFrame:
    """Both gates over atoms and the lines of a report whose header says one too many, with another indented list below; the lines lie in many blocks."""
    atoms, listed = status_report(g)
    k = F.col("name").cast("bigint") % 5
    held = F.when(k == 1, F.array(F.lit("b"), F.lit("a"))).when(k == 2, F.array(F.lit("a"), F.lit("sorryAx"))).when(k > 2, F.array().cast("array<string>"))
    published = atoms.select(F.concat(F.lit("probe:"), "name").alias("name"), F.col("status").alias("verification-status"), F.col("origin").alias("status-origin"), held.alias("assumptions"))
    listed = written(listed, "listed")
    flags = F.concat(F.when(F.col("direct"), F.lit(" [direct]")).otherwise(F.lit("")), F.when(F.col("emitted"), F.lit("")).otherwise(F.lit(" [not emitted]")))
    rows = listed.select((F.col("name").cast("bigint") + 10).alias("place"), F.concat(F.lit("  "), "name", flags, F.when(k == 0, F.lit(" ")).otherwise(F.lit(""))).alias("line"))
    head = listed.agg(F.lit(5).cast("bigint").alias("place"), F.concat((F.count(F.lit(1)) + 1).cast("string"), F.lit(" constant(s) rest on an unexcused project sorry:")).alias("line"))
    rest = g.trusted.select((F.col("id") + 10**12).alias("place"), F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" "), "reason").alias("line"))
    other = g.spark.sql("SELECT * FROM VALUES (0L, 'Project'), (1L, '  17'), (999999999999L, '9 trusted constant(s) (T):') AS t(place, line)")
    lines = rows.union(head).union(rest).union(other).select(F.lit("report").alias("path"), F.expr("place div 64").alias("block"), "place", "line")
    return gates.status_gate(published, lines)


def run_notes(g: Graph) -> DataFrame:
    """Every note of a run over the derived tables; names of one statement in five are given the ending of what the compiler makes."""
    version = g.version.withColumn("name", F.when(F.col("type_hash") == "h1", F.concat("name", F.lit(".eq_1"))).otherwise(F.col("name")))
    named = lambda df, c: df.select(F.col(c).cast("string").alias("name"))
    return A.run_notes(version, named(COLUMNS["generated_axioms"](g), "id"), named(COLUMNS["ambiguous_primary_specs"](g), "target"), named(COLUMNS["dependency_roots"](g), "root"), named(G.duplicate_names(g.decl), "code_name"), coimport_collisions(g).select("name"))


def dump_of(g: Graph) -> Dump:
    """The derived declarations as a dump: names without meaning, one version each; auxiliaries are those without lines."""
    ref = lambda c: F.when(F.col(c) == D.SORRY, F.lit(T.SORRY)).otherwise(F.concat(F.lit("N"), F.col(c).cast("string")))
    used = g.edge.groupBy(F.col("src").alias("id")).agg(*[F.collect_set(F.when(F.col("role") == r, ref("dst"))).alias(f"{r}_used") for r in ("type", "value")])
    none = F.array().cast("array<string>")
    x = g.decl.join(sized(used), "id", "left")
    flag = lambda name: (F.col("kind") == name).alias(f"is_{name}")
    off = [F.lit(False).alias(c) for c in ("is_instance", "is_class", "is_projection", "is_protected", "is_universe_typed", "is_bv_decide_type", "codomain_is_prop", "codomain_is_type", "codomain_last_arg_is_bool")]
    text = [F.lit(None).cast("string").alias(c) for c in ("codomain_head", "step_program_head", "docstring", "body_docstring", "type_pp")]
    lines = [F.when(~F.col("aux"), (F.col("id") + k).cast("int")).alias(c) for k, c in ((1, "range_start"), (2, "range_end"))]
    arrays = [F.coalesce(f"{r}_used", none).alias(f"{r}_used{tail}") for tail in ("", "_emitted") for r in ("type", "value")]
    constant = x.select(ref("id").alias("name_id"), ref("id").alias("name"), "module", F.col("module").alias("owner_module"), F.lit(True).alias("is_kept"), "ctor_kind", *arrays, none.alias("ctors"), "type_is_prop", F.col("tagged").alias("externally_verified_tag"), F.col("is_primary_spec").alias("primary_spec_tag"), *lines, flag("structure"), flag("abbrev"), *off, *text)
    core = constant.where("name_id = 'N0'").withColumns({"name_id": F.lit(T.SORRY), "name": F.lit(T.SORRY), "module": F.lit("Core"), "owner_module": F.lit("Core"), "ctor_kind": F.lit("axiom"), "externally_verified_tag": F.lit(False), "type_used": none, "value_used": none})
    module = x.select("module", "in_project").distinct().select("module", F.col("in_project").alias("in_build_dir")).union(g.spark.sql("SELECT 'Core', false"))
    imports = module.where("module <> 'Pkg.M0.Funs'").select(F.lit("Pkg.M0.Funs").alias("module"), F.col("module").alias("imported"))
    return Dump(constant.union(core.select(constant.columns)), module, imports, module.where("module = 'Pkg.M0.Funs'").select("module"))


def extract_command(g: Graph) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    out = commands.extract(dump_of(g))
    return out.select(F.col("code_name").alias("name"), "kind", "status", "reason", "origin", size("type_deps").alias("n_type"), size("term_deps").alias("n_term"), size(F.array_union(F.coalesce("type_deps_external", F.array().cast("array<string>")), F.coalesce("term_deps_external", F.array().cast("array<string>")))).alias("n_external"), "primary_spec")


def check_axioms_command(g: Graph) -> DataFrame:
    return commands.check_axioms(dump_of(g))["tainted"].select("name", "is_emitted", "is_direct")


def check_axioms_trusted(g: Graph) -> DataFrame:
    return commands.check_axioms(dump_of(g))["trusted"].select("name", "reason", "is_statement_tainted")


def document_entries(g: Graph) -> DataFrame:
    """Declarations written as one document side by side and read back by cutting it; names and texts hold the marks that it is cut at."""
    text = F.concat(F.lit('} "'), "kind", F.lit('": {\\'))
    body = F.to_json(F.struct("kind", text.alias("text"), F.struct("lines_start").alias("place")))
    path = f"{shared_folder(g.spark)}/lemmaflow/entries-{uuid.uuid4().hex}"
    write_document(g.decl.select(F.concat(F.lit('probe:{"'), "id").alias("name"), body.alias("body")), path, {"schema": "x", "inputs": [{"data": {}}]}, whole=False)
    value = lambda at, kind: F.try_variant_get("atom", at, kind)
    return entries(g.spark, path, parts=True).select("name", value("$.kind", "string").alias("kind"), value("$.text", "string").alias("text"), value("$.place.lines_start", "int").alias("lines_start"))


def viewify_command(g: Graph) -> DataFrame:
    shown = commands.extract(dump_of(g), skip_verify=True)
    return commands.viewify(commands.published(shown)).select("view_key", "code_lines")


def line_ranges(g: Graph) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("L"), F.col("id").cast("string"), F.lit("-L"), (F.col("id") + 5).cast("string"))).when(F.col("id") % 3 == 1, F.concat(F.col("id").cast("string"), F.lit("-"), (F.col("id") + 7).cast("string"))).otherwise(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.lit("x")))
    r = N.line_range(text)
    return g.decl.select("id", r["lines_start"].alias("lines_start"), r["lines_end"].alias("lines_end"))


def rust_source(g: Graph) -> DataFrame:
    doc = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Adds. Source: 'src/"), "kind", F.lit(".rs' lines 1"))).when(F.col("id") % 4 == 1, F.lit("Source: '/root/.cargo/registry/x.rs'")).otherwise(F.lit("none"))
    source = N.rust_source(doc)
    return g.decl.select("id", source.alias("source"), F.coalesce(N.is_relevant_source(source, "src"), F.lit(False)).alias("is_relevant"))


def strip_comments(g: Graph) -> DataFrame:
    docs = table(g.spark, g.folder, "documents").select("doc_id", "text")
    return docs.mapInPandas(stripped, "doc_id bigint, text string").select("doc_id", F.sha2("text", 256).alias("code_sha256"))


COLUMNS: dict[str, Callable[[Graph], DataFrame]] = {
    "decl_kind": lambda g: g.decl.select("id", N.decl_kind(F.col("ctor_kind"), flags(g)).alias("kind")),
    "internal_name_filter": lambda g: g.decl.select("id", N.is_internal(F.col("name")).alias("is_internal"), N.is_structural_member(F.col("name")).alias("is_structural"), N.is_realised_theorem(F.col("name")).alias("is_realised")),
    "emitted_decls": lambda g: g.decl.where(~N.is_internal(F.col("name")) & F.col("lines_start").isNotNull()).select("id", "name"),
    "display_name": lambda g: g.decl.select("id", N.display_name(F.split("name", r"\.")).alias("display_name"), N.without_prefix(F.col("code_name")).alias("bare_name"), N.module_path(F.col("module")).alias("path")),
    "trusted_base": lambda g: g.trusted,
    "trust_reason_counts": lambda g: g.trusted.groupBy("reason").agg(F.count("*").alias("n")),
    "rule3_candidates": lambda g: g.decl.where(N.is_external_module(F.col("module")) & (F.col("ctor_kind") != "thm") & (F.col("kind") != "axiom")).select("id", F.coalesce(F.when(F.col("carrier"), F.lit(None)).otherwise(F.col("type_is_prop")), F.lit(True)).alias("counts_as_proof")),
    "merged_trust": lambda g: T.merged_trust(g.version.where("in_project").withColumnRenamed("name", "id")),
    "walk_edges": lambda g: g.walk(),
    "statement_edges": lambda g: T.statement_edges(g.edge),
    "proof_edges": lambda g: T.proof_edges(g.edge),
    "dependency_union": lambda g: G.dependency_arrays(g.edge).select("src", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("type_deps", "term_deps", "deps")]),
    "external_split": lambda g: G.external_split(g.edge, g.ids("id % 20 <> 13"), g.ids("aux")),
    "direct_carriers": lambda g: T.direct_carriers(g.walk(), D.SORRY),
    "tainted": lambda g: T.tainted(written(g.walk(), "walk"), D.SORRY),
    "verification_status": lambda g: g.status(),
    "status_skip_enrich": lambda g: g.status(skip_enrich=True),
    "status_skip_verify": lambda g: g.status(skip_verify=True),
    "status_counts": lambda g: T.status_counts(g.status()),
    "unhide_contaminated": lambda g: T.unhidden(g.decl.join(sized(g.status().select("id", "status")), "id")).select("id", "is_hidden"),
    "assumption_sets": lambda g: g.assumptions(T.assumption_pairs),
    "assumption_report": lambda g: g.report(g.assumptions(T.assumption_holders)).select("label", "category", "n"),
    "assumption_category_counts": lambda g: T.category_counts(g.report(g.assumptions(T.labels_in_use))).select("place", "category", "n_labels"),
    "fold_closure": lambda g: g.closure(),
    "folded_term_deps": lambda g: g.folded(),
    "fold_recovered_edges": lambda g: G.recovered_edges(g.edge, g.folded()),
    "merged_decls": lambda g: G.merge_classes(g.version).where("class = 'merged'").select("name", F.array_join("modules", ",").alias("modules")),
    "cross_boundary": lambda g: G.merge_classes(g.version).where("class = 'cross'").select("name", F.array_join("modules", ",").alias("modules")),
    "duplicate_versions": lambda g: G.duplicate_versions(g.version),
    "coimport_collisions": coimport_collisions,
    "specs": lambda g: g.specs(),
    "primary_spec": lambda g: G.primary_specs(written(g.specs(), "specs"), g.atoms()),
    "primary_spec_rules": lambda g: G.primary_specs(*specified(g)),
    "ambiguous_primary_specs": lambda g: G.ambiguous_primary_specs(*specified(g)),
    "derived_instance_clusters": lambda g: G.derived_instance_clusters(g.decl.select("id", "name", "module", F.col("lines_start").alias("range_start"), F.col("lines_end").alias("range_end"), F.when(F.col("is_aeneas_generated"), F.lit("instance")).otherwise(F.col("kind")).alias("kind"))),
    "companion_theorems": lambda g: G.companion_theorems(g.decl),
    "import_closure": import_closure,
    "narrow_closure": lambda g: G.import_closure(g.module.where("s_nationkey % 2 = 1"), g.imports, G.within_prefix(g.module, "L3").select("module")),
    "unresolved_imports": lambda g: G.unresolved_imports(g.module.where("s_nationkey <> 3"), g.imports),
    "ownership": ownership,
    "emitted_modules": emitted_modules,
    "module_prefix": lambda g: G.within_prefix(g.decl.select("module").distinct(), "Pkg.M1").select("module"),
    "owners_exact_cover": owners_exact_cover,
    "view_unique_keys": lambda g: G.unique_keys(G.view_atoms(g.decl)).select("id", "view_key"),
    "view_molecules": lambda g: G.molecules(G.unique_keys(G.view_atoms(g.decl))),
    "duplicate_names": lambda g: G.duplicate_names(g.decl),
    "graph_check": lambda g: A.graph_divergences(written(g.status().select("id", F.when(F.col("id") % 40 == 0, F.lit("verified")).otherwise(F.col("status")).alias("status"), "origin"), "status"), g.edge),
    "missing_dependencies": missing,
    "in_degree_rescue": lambda g: A.in_degree_rescue(g.edge, g.folded(), g.ids("NOT aux")),
    "status_consistency": lambda g: A.status_consistency(*two_reports(g)),
    "artifact_diff": lambda g: A.artifact_diff(*two_reports(g), [("transitively-verified", "verified"), ("trusted", "transitively-verified"), ("unverified", "verified")]),
    "attribute_scan": attribute_scan,
    "tag_audit": lambda g: H.tag_audit(*scanned_attributes(g)),
    "head_lines": head_lines,
    "fold_classes": fold_classes,
    "fold_stats": lambda g: G.fold_stats(g.edge, g.folded(), fold_classes(g)),
    "fixpoint_bodies": fixpoint_bodies,
    "companion_heads": companion_heads,
    "merged_location": lambda g: G.merged_location(D.derived(g.spark, g.folder, D.LOCATION)),
    "closure_problems": closure_problems,
    "loaded_differences": lambda g: G.loaded_differences(g.module.where("s_nationkey % 7 <> 1"), written(import_closure(g), "closure"), g.module.where("in_build_dir")),
    "missing_builds": lambda g: G.missing_builds(import_closure(g), g.module.where("s_nationkey % 6 <> 2")),
    "dependency_roots": lambda g: G.dependency_roots(*[g.module.where(w).select(F.concat(F.lit("R"), F.col("s_nationkey").cast("string"), F.lit("."), "module").alias("module")) for w in ("true", "in_build_dir")]),
    "generated_axioms": lambda g: T.generated_axioms(g.trusted, g.decl.select("id", (~N.is_internal(F.col("name")) & F.col("lines_start").isNotNull()).alias("is_visible"))),
    "example_module": example_modules,
    "already_contained": lambda g: g.decl.select("id", G.already_contained(F.when(F.col("id") % 3 > 0, F.concat(F.lit("import failed, environment already contains '"), "name", F.lit("'' from A"))).otherwise(F.lit("other"))).alias("name")),
    "shape_histogram": lambda g: A.shape_histogram(g.edge, g.decl, g.closure(), g.ids("NOT aux")),
    "proof_carriers": lambda g: A.proof_carriers(g.edge, g.decl, g.ids("aux")),
    "hidden_by_position": lambda g: A.hidden_by_position(g.edge, g.closure(), g.ids("NOT aux")),
    "compare_artifacts": lambda g: gates.compare_artifacts(*artifacts(g), policy="taint"),
    "added_dependencies": lambda g: gates.added_dependencies(*artifacts(g)),
    "status_problems": lambda g: gates.status_problems(*status_report(g)),
    "assumption_problems": assumption_problems,
    "status_gate": status_gate,
    "run_notes": run_notes,
    "line_ranges": line_ranges,
    "rust_source": rust_source,
    "extract_command": extract_command,
    "check_axioms_command": check_axioms_command,
    "check_axioms_trusted": check_axioms_trusted,
    "viewify_command": viewify_command,
    "document_entries": document_entries,
    "strip_comments": strip_comments,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Graph(spark, folder))) for name, f in COLUMNS.items()}
