"""The three commands over a dump's tables: extract, check_axioms and viewify.

``Dump`` holds the tables: ``constant`` (one row per module and name), ``module``,
``module_import``, the chosen target modules, and the source lines if they are at hand.
Building projects, reading compiled files and printing terms happen elsewhere; their
results are columns here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions import names as N
from lemmaflow.functions.lexer import strip_sources
from lemmaflow.operators import graph as G
from lemmaflow.operators import headers as H
from lemmaflow.operators import trust as T
from lemmaflow.plans.scratch import sized, written
from lemmaflow.sources import artifact as A
from lemmaflow.sources.project import Config, flagged

#: Problems that a refusal lists.
SHOWN = 10


@dataclass
class Dump:
    constant: DataFrame
    module: DataFrame
    module_import: DataFrame
    targets: DataFrame
    source_file: DataFrame | None = None


@dataclass
class Analysis:
    """What every command shares.

    ``decl`` has the project's names and the kept constants outside, ``constant`` every
    version with ``in_project``, ``edge`` the edges of project versions and of constants
    outside, ``extra`` those of outside versions of names with several.
    """

    constant: DataFrame
    project: DataFrame
    decl: DataFrame
    edge: DataFrame
    extra: DataFrame
    walk: DataFrame
    trusted: DataFrame
    verdict: DataFrame
    merges: DataFrame


class Tables(Mapping):
    """Tables by name, each built once, when it is first asked for."""

    def __init__(self, build: dict[str, Callable[[], DataFrame]]):
        self.build, self.get_built = build, cache(lambda name: build[name]())

    def __getitem__(self, name: str) -> DataFrame:
        return self.get_built(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.build)

    def __len__(self) -> int:
        return len(self.build)


class ProjectError(ValueError):
    """A project that can't be read as one environment; ``problems`` is the whole table."""

    def __init__(self, what: str, problems: DataFrame):
        super().__init__(f"{what}: " + "; ".join(", ".join(str(v) for v in r if v is not None) for r in problems.limit(SHOWN).collect()))
        self.problems = problems


def optional(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)


def collisions(dump: Dump, project: DataFrame) -> DataFrame:
    """(name, modules) that modules of the project declare in ways that one environment can't hold; modules without their proofs are left out."""
    proofs = optional(optional(dump.module, "is_module_system", F.lit(False)), "has_parts", F.lit(True)).where("NOT is_module_system OR has_parts")
    own = dump.constant.join(project, "module", "left_semi").join(proofs.select("module"), "module", "left_semi").withColumn("name", F.col("name_id"))
    for column, default in (("type_hash", F.lit("")), ("level_params", F.array().cast("array<string>")), ("all_names", F.array("name_id")), ("is_unsafe", F.lit(False))):
        own = optional(own, column, default)
    clash = G.coimport_collisions(own)
    return own.join(sized(clash), "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def prepare(dump: Dump) -> DataFrame:
    """The project's modules; a closure that can't be read, modules without proofs and clashing names are errors."""
    problems = written(G.closure_problems(dump.module, dump.module_import, dump.targets), "problems")
    if not problems.isEmpty():
        raise ProjectError("the import closure cannot be read", problems)
    project = written(G.import_closure(dump.module, dump.module_import, dump.targets), "project")
    parts = optional(optional(dump.module, "is_module_system", F.lit(False)), "has_parts", F.lit(True))
    proofless = parts.join(project, "module", "left_semi").where("is_module_system AND NOT has_parts").select("module")
    if not proofless.isEmpty():
        raise ProjectError("modules without their private parts", proofless)
    if "type_hash" in dump.constant.columns:
        clash = written(collisions(dump, project).where(G.displayable(F.col("name"))), "collisions")
        if not clash.isEmpty():
            raise ProjectError("names that several modules declare", clash.select("name", F.array_join("modules", " and ")))
    return project


def analyse(dump: Dump, project: DataFrame | None = None) -> Analysis:
    """Versions and declarations, trust over them, and the status walk, which follows project versions alone."""
    project = prepare(dump) if project is None else project
    constant = dump.constant.join(project.select("module", F.lit(True).alias("p")), "module", "left")
    constant = optional(constant.withColumn("in_project", F.coalesce("p", F.lit(False))).drop("p"), "fixpoint_body_of", F.lit(None).cast("string"))
    constant = optional(constant, "own_handle_tag", F.lit(False))
    constant = written(constant, "constant")
    inside = constant.where("in_project")
    own = inside.select("name_id").distinct()
    outside = constant.where("NOT in_project AND is_kept").join(sized(own), "name_id", "left_anti")
    edge = written(G.constant_edges(inside.unionByName(outside)), "edge")
    merges = written(G.merge_classes(constant.select(F.col("name_id").alias("name"), "module", "in_project")), "merges")
    several = merges.select(F.col("name").alias("id"))
    prefer = F.struct(~F.col("is_kept"), F.col("module"))
    first = ["name", "owner_module", "ctor_kind", "type_is_prop", "codomain_head", "step_program_head", "docstring", "body_docstring", "type_pp", "fixpoint_body_of"]
    either = ["is_instance", "is_class", "is_structure", "is_projection", "is_abbrev", "is_protected", "primary_spec_tag", "is_universe_typed", "is_bv_decide_type", "codomain_is_prop", "codomain_is_type", "codomain_last_arg_is_bool"]
    shown = constant.where("in_project OR is_kept")
    decl = shown.groupBy(F.col("name_id").alias("id")).agg(
        F.bool_or("in_project").alias("in_project"),
        F.bool_or(F.col("externally_verified_tag") | F.col("own_handle_tag")).alias("tagged"),
        F.bool_or(F.col("is_kept") & F.col("range_start").isNotNull()).alias("has_range"),
        *[F.min_by(c, prefer).alias(c) for c in first],
        *[F.bool_or(F.col("is_kept") & F.col(c)).alias(c) for c in either],
    )
    axiom = G.axiom_versions(constant).withColumn("a", F.lit(True))
    decl = decl.join(sized(axiom), "id", "left").withColumn("axiom_version", F.coalesce("a", F.lit(False))).drop("a").withColumnRenamed("owner_module", "module")
    decl = decl.withColumn("kind", N.decl_kind(F.col("ctor_kind"), {k: F.col(k) for k in ("is_instance", "is_projection", "is_abbrev", "is_class", "is_structure")}))
    decl = decl.withColumns({"module_external": N.is_external_module(F.col("module")), "is_visible": ~N.is_internal(F.col("name")) & ~F.col("ctor_kind").isin("ctor", "rec") & F.col("has_range")})
    decl = written(G.companion_heads(decl), "decl")
    plain = T.trust_base(decl.join(sized(several), "id", "left_anti"))
    kind = F.when(F.col("ctor_kind") == "axiom", F.lit("axiom")).otherwise(F.lit("other"))
    versions = inside.select(F.col("name_id").alias("id"), "module", kind.alias("kind"), N.is_external_module(F.col("module")).alias("module_external"), F.when(F.col("ctor_kind") == "thm", F.lit(True)).otherwise(F.col("type_is_prop")).alias("type_is_prop"))
    trusted = written(plain.union(T.merged_trust(versions.join(sized(several), "id", "left_semi"))), "trusted")
    walk = written(T.walk_edges(edge, decl, trusted), "walk")
    verdict = written(T.verdicts(decl, trusted, T.tainted(walk, T.SORRY), T.direct_carriers(walk, T.SORRY)), "verdict")
    return Analysis(constant, project, decl, edge, G.outside_edges(constant), walk, trusted, verdict, merges)


def selected_modules(dump: Dump, project: DataFrame, module_prefix: str | None, libraries: DataFrame | None) -> DataFrame:
    """Modules to show: under a prefix and what those import, or the libraries' own and imported, or the whole project."""
    if module_prefix:
        return G.import_closure(dump.module, dump.module_import, G.within_prefix(project, module_prefix).select("module"))
    if libraries is None:
        return project
    return G.emitted_modules(project, G.import_closure(dump.module, dump.module_import, libraries), libraries, narrow=False)


def assumption_table(a: Analysis) -> DataFrame:
    """(id, label) over versions of the project and outside it."""
    return T.assumption_pairs(a.decl, a.edge, a.trusted, T.SORRY, T.STANDARD_AXIOMS, extra=a.extra)


def assumptions(a: Analysis) -> DataFrame:
    """(id, assumptions): sorted names, empty where a declaration rests on nothing."""
    named = assumption_table(a).join(sized(a.decl.select(F.col("id").alias("label"), "name")), "label", "left")
    held = named.groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("name", "label"))).alias("assumptions"))
    return a.decl.where("in_project").select("id").join(sized(held), "id", "left").select("id", F.coalesce("assumptions", F.array().cast("array<string>")).alias("assumptions"))


def sources_of(shown: DataFrame, dump: Dump) -> DataFrame:
    """``shown`` with code_path, attributes and whether the header names the tag; without source lines only known attributes and the module's path."""
    path = N.module_path(F.col("module"))
    if dump.source_file is None:
        known = H.declared_attributes(shown, shown.sparkSession.createDataFrame([], "id string, attributes array<string>, head string"))
        return shown.withColumn("code_path", path).join(sized(known), "id")
    placed = written(H.located(path, dump.source_file, shown), "placed")
    code = written(strip_sources(dump.source_file), "code")
    scan = H.scan_headers(placed.select("id", F.col("code_path").alias("path"), "range_start", "range_end"), code)
    return placed.join(sized(H.declared_attributes(placed, scan)), "id")


def extract(dump: Dump, config: Config | None = None, module_prefix: str | None = None, libraries: DataFrame | None = None, skip_verify: bool = False, skip_enrich: bool = False) -> DataFrame:
    """The atoms of a project: edges with folded auxiliaries, flags, specifications, status and assumptions.

    Dependencies and specifications are code names, in order. ``published`` makes an
    artifact's columns of the result.
    """
    config = config or Config()
    project = prepare(dump)
    if module_prefix and G.within_prefix(project, module_prefix).isEmpty():
        raise ValueError(f"no module of the project is {module_prefix} or lies under it")
    a = analyse(dump, project)
    chosen = selected_modules(dump, project, module_prefix, libraries)
    versions = a.constant.where("in_project").join(chosen.select("module", F.lit(True).alias("s")), "module", "left").withColumn("selected", F.coalesce("s", F.lit(False)))
    place = G.merged_location(versions.select(F.col("name_id").alias("name"), "module", "owner_module", "selected", "range_start", "range_end")).withColumnRenamed("name", "id")
    shape = ~N.is_internal(F.col("name")) & ~F.col("ctor_kind").isin("ctor", "rec")
    shown = written(a.decl.where(F.col("in_project") & shape).drop("module").join(sized(place), "id"), "shown")
    ids = shown.select("id")
    emitted = written(G.constant_edges(a.constant.where("in_project"), emitted=True), "emitted")
    classes = G.fold_classes(emitted.select(F.col("dst").alias("id")).union(a.decl.select("id")), a.decl)
    foldable = classes.where("class = 'foldable'").select("id").join(sized(ids), "id", "left_anti")
    closure = G.fold_closure(emitted, foldable, ids)
    folded = G.folded_edges(emitted, closure, ids).withColumn("role", F.lit("value"))
    seen = a.decl.join(sized(ids.withColumn("s", F.lit(True))), "id", "left").withColumn("is_shown", F.coalesce("s", F.lit(False)))
    dropped = a.decl.where(N.is_internal(F.col("name"))).select("id").union(G.fixpoint_bodies(seen))
    every = emitted.unionByName(folded).distinct().join(sized(ids.withColumnRenamed("id", "src")), "src", "left_semi")
    selected_names = versions.where("selected").select(F.col("name_id").alias("id")).distinct()
    every = written(G.external_split(every, selected_names, dropped), "dependencies")
    coded = every.join(sized(a.decl.select(F.col("id").alias("dst"), N.with_prefix(F.col("name")).alias("code"))), "dst", "left").withColumn("dst", F.coalesce("code", N.with_prefix(F.col("dst"))))
    inner, outer = G.dependency_arrays(coded.where("NOT external")), G.dependency_arrays(coded.where("external"))
    atoms = shown.join(sized(inner.withColumnRenamed("src", "id")), "id", "left").join(sized(outer.select(F.col("src").alias("id"), F.col("type_deps").alias("type_deps_external"), F.col("term_deps").alias("term_deps_external"))), "id", "left")
    made = G.companion_theorems(a.decl.where("in_project")).union(G.derived_instance_clusters(shown)).distinct().withColumn("made", F.lit(True))
    body = a.decl.select(F.regexp_replace("name", "_body$", "").alias("name"), F.col("docstring").alias("of_body")).where(a.decl["name"].endswith("_body")).groupBy("name").agg(F.min("of_body").alias("of_body"))
    atoms = sources_of(atoms.join(sized(made), "id", "left"), dump).join(sized(body), "name", "left").withColumns({
        "code_name": N.with_prefix(F.col("name")),
        "display_name": N.last_part(F.col("name")),
        "rust_source": F.coalesce(N.rust_source(F.col("docstring")), N.rust_source(F.col("body_docstring")), N.rust_source(F.col("of_body"))),
        "lines_start": F.when(F.col("code_path") != "", F.col("range_start")),
        "lines_end": F.when(F.col("code_path") != "", F.col("range_end")),
        "is_hidden": F.lit(False),
        "is_ignored": F.lit(False),
        "is_lean_generated": F.coalesce("made", F.lit(False)),
        "is_aeneas_generated": F.lit(False),
        "is_primary_spec": F.col("primary_spec_tag"),
        "is_proof": F.coalesce("type_is_prop", F.lit(True)),
    }).drop("made", "of_body")
    atoms = flagged(atoms, config).withColumn("is_relevant", F.coalesce(N.is_relevant_source(F.col("rust_source"), config.relevant_crate), F.lit(False)))
    atoms = written(atoms, "atoms")
    relation = written(G.specs(atoms, every.where("NOT external AND role <> 'value'"), every.where("NOT external")), "specs")
    listed = relation.join(sized(atoms.select(F.col("id").alias("source"), "code_name")), "source").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("code_name")).alias("specs"))
    best = G.primary_specs(relation, atoms).join(sized(atoms.select(F.col("id").alias("source"), F.col("code_name").alias("primary_spec"))), "source").select(F.col("target").alias("id"), "primary_spec")
    out = atoms.join(sized(listed), "id", "left").join(sized(best), "id", "left").join(sized(T.stamped(a.verdict, skip_enrich, skip_verify)), "id", "left")
    if not skip_verify:
        out = out.join(sized(assumptions(a)), "id", "left")
    return out if skip_enrich else T.unhidden(out)


def published(atoms: DataFrame) -> DataFrame:
    """The columns of an artifact (as ``read_atoms`` returns them) from what ``extract`` returns."""
    none = F.array().cast("array<string>")
    known = {
        "display-name": F.col("display_name"), "kind": F.col("kind"), "language": F.lit("lean"),
        "dependencies": F.coalesce("deps", none), "type-dependencies": F.coalesce("type_deps", none), "term-dependencies": F.coalesce("term_deps", none),
        "code-module": F.col("module"), "code-path": F.col("code_path"),
        "code-text": F.when(F.col("lines_start").isNotNull(), F.struct(F.col("lines_start").alias("lines-start"), F.col("lines_end").alias("lines-end"))),
        "rust-source": F.col("rust_source"), "is-in-package": F.lit(True),
        "type-dependencies-external": F.coalesce("type_deps_external", none), "term-dependencies-external": F.coalesce("term_deps_external", none),
        "attributes": F.col("attributes"), "specs": F.coalesce("specs", none), "primary-spec": F.col("primary_spec"),
        "verification-status": F.col("status"), "trusted-reason": F.col("reason"), "status-origin": F.col("origin"),
        "assumptions": F.col("assumptions") if "assumptions" in atoms.columns else F.lit(None).cast("array<string>"), "codomain-head": F.col("codomain_head"),
    }
    return atoms.select(F.col("code_name").alias("name"), *[known[f].cast(kind).alias(f) if f in known else F.col(f.replace("-", "_")).alias(f) for f, kind in A.FIELDS])


def check_axioms(dump: Dump) -> Mapping[str, DataFrame]:
    """Report tables: tainted declarations, the trust base, assumptions with their categories, generated axioms, the tag audit and what lies outside.

    The project is read and walked at once; what a table needs beyond that, assumptions
    above all, is worked out when the table is asked for.
    """
    a = analyse(dump)
    bad = a.verdict.where("verdict IN ('direct', 'tainted')")

    def tainted() -> DataFrame:
        direct = T.direct_carriers(a.walk, T.SORRY).withColumn("is_direct", F.lit(True))
        found = bad.join(sized(a.decl.select("id", "name", "module", F.col("is_visible").alias("is_emitted"))), "id").join(sized(direct), "id", "left")
        return found.select("id", "name", "module", "is_emitted", F.coalesce("is_direct", F.lit(False)).alias("is_direct"))

    def trusted() -> DataFrame:
        base = a.trusted.join(sized(a.decl.select("id", "name", "module", "type_pp")), "id").join(sized(bad.select("id", F.lit(True).alias("is_statement_tainted"))), "id", "left")
        return base.select("id", "reason", "name", "module", "type_pp", F.coalesce("is_statement_tainted", F.lit(False)).alias("is_statement_tainted"))

    def assumptions_held() -> DataFrame:
        held = written(T.assumption_holders(a.decl, a.edge, a.trusted, T.SORRY, T.STANDARD_AXIOMS, extra=a.extra), "held")
        facts = a.decl.join(sized(a.trusted), "id", "left").select("id", F.when(F.col("ctor_kind") == "axiom", F.lit("axiom")).otherwise(F.col("kind")).alias("kind"), "in_project", F.col("is_bv_decide_type").alias("is_bv_decide"), N.is_native_axiom(F.col("name")).alias("is_native"), "is_universe_typed", "axiom_version", "reason")
        return T.assumption_report(held, T.assumption_category(facts, T.SORRY, T.STANDARD_AXIOMS, T.COMPILER_AXIOMS))

    def tag_audit() -> DataFrame:
        seen = a.decl.where("in_project AND is_visible")
        place = G.merged_location(a.constant.where("in_project").select(F.col("name_id").alias("name"), "module", "owner_module", F.lit(True).alias("selected"), "range_start", "range_end")).withColumnRenamed("name", "id")
        return H.tag_audit(seen, sources_of(seen.drop("module").join(sized(place), "id"), dump).select("id", "attributes", "shows_tag", "names_tag"))

    tables = Tables({
        "tainted": tainted,
        "trusted": trusted,
        "assumptions": assumptions_held,
        "categories": lambda: T.category_counts(tables["assumptions"]),
        "generated_axioms": lambda: T.generated_axioms(a.trusted, a.decl),
        "merges": lambda: a.merges.select("name", "class", "modules", N.is_realised_theorem(F.col("name")).alias("is_realised")),
        "tag_audit": tag_audit,
        "dependency_roots": lambda: G.dependency_roots(dump.module, a.project),
    })
    return tables


def viewify(atoms: DataFrame) -> DataFrame:
    """Molecules of the atoms that a view shows, under unique keys; ``atoms`` has an artifact's columns."""
    plain = atoms.select(
        F.col("name").alias("code_name"), F.col("`code-path`").alias("code_path"), F.col("`code-text`.`lines-start`").alias("lines_start"), F.col("`code-text`.`lines-end`").alias("lines_end"),
        *[F.col(f"`is-{f}`").alias(f"is_{f.replace('-', '_')}") for f in ("hidden", "lean-generated", "aeneas-generated", "relevant")],
    )
    return G.molecules(G.unique_keys(G.view_atoms(plain)))
