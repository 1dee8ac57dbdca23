"""Edges, folding, merging, selection, specifications and views of declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.names import SPEC_ATTRIBUTES, SPEC_TARGET_KINDS, is_internal, is_structural_member, last_part, user_name
from lemmaflow.plans.fixpoint import closure_pairs, reachable
from lemmaflow.plans.scratch import sized, written

VALUED = ["defn", "thm", "opaque"]


def constant_edges(constant: DataFrame, emitted: bool = False) -> DataFrame:
    """(src, dst, role) of constants: types for all but quotients, values of those that have one, constructors of inductives."""
    tail = "_emitted" if emitted else ""
    kind = F.col("ctor_kind")
    part = lambda name, role, when: constant.where(when).select(F.col("name_id").alias("src"), F.explode(name).alias("dst"), F.lit(role).alias("role"))
    out = part(f"type_used{tail}", "type", kind != "quot").union(part(f"value_used{tail}", "value", kind.isin(VALUED)))
    return out.union(part("ctors", "ctor", kind == "induct")).distinct()


def dependency_arrays(edge: DataFrame) -> DataFrame:
    """(src, type_deps, term_deps, deps): sorted arrays by position and their union."""
    pick = lambda role: F.array_sort(F.collect_set(F.when(F.col("role").isin(role), F.col("dst"))))
    out = edge.groupBy("src").agg(pick(["type", "ctor"]).alias("type_deps"), pick(["value"]).alias("term_deps"))
    return out.withColumn("deps", F.array_sort(F.array_union("type_deps", "term_deps")))


def external_split(edge: DataFrame, project: DataFrame, internal: DataFrame) -> DataFrame:
    """``edge`` without targets in ``internal`` (id: internal names and generated fixpoint bodies), with ``external`` for targets outside ``project`` (id)."""
    shown = edge.join(sized(internal.select(F.col("id").alias("dst"))), "dst", "left_anti")
    inside = project.select(F.col("id").alias("dst"), F.lit(False).alias("outside"))
    return shown.join(sized(inside), "dst", "left").select("src", "dst", "role", F.coalesce("outside", F.lit(True)).alias("external"))


def fold_classes(names: DataFrame, constant: DataFrame) -> DataFrame:
    """(id, class) of names met while folding: unresolved, emitted, foldable or ignored.

    ``constant`` has (id, name, in_project, has_range, ctor_kind), one row a name. A name
    that the dump doesn't know is unresolved before anything else is asked.
    """
    x = names.select("id").distinct().join(sized(constant.select("id", "name", "in_project", "has_range", "ctor_kind")), "id", "left")
    hidden = is_internal(F.col("name")) | (F.col("in_project") & ~F.col("has_range"))
    folds = ~is_structural_member(F.col("name")) & F.col("ctor_kind").isin(VALUED)
    found = F.when(F.col("name").isNull(), F.lit("unresolved")).when(hidden & folds, F.lit("foldable")).when(~hidden & F.col("in_project"), F.lit("emitted"))
    return x.select("id", F.coalesce(found, F.lit("ignored")).alias("class"))


def fixpoint_bodies(decl: DataFrame) -> DataFrame:
    """Ids of project constants made as the common body of a fixpoint block: named ``f.mutual``, not shown, and recorded as the body of ``f``.

    ``decl`` has (id, name, in_project, is_shown, fixpoint_body_of).
    """
    own = F.col("name") == F.concat("fixpoint_body_of", F.lit(".mutual"))
    return decl.where(F.col("in_project") & ~F.col("is_shown") & own).select("id")


def companion_heads(decl: DataFrame) -> DataFrame:
    """``decl`` (id, name, ctor_kind, step_program_head) where a companion of an axiom without a head of its own takes the axiom's."""
    parent = decl.where("ctor_kind = 'axiom' AND step_program_head IS NOT NULL").groupBy(F.concat("name", F.lit(".mvcgen_spec")).alias("name")).agg(F.min("step_program_head").alias("parent_head"))
    return decl.join(sized(parent), "name", "left").withColumn("step_program_head", F.coalesce("step_program_head", "parent_head")).drop("parent_head")


def fold_stats(edge: DataFrame, folded: DataFrame, classes: DataFrame) -> DataFrame:
    """(n_edges, n_atoms, n_foldable, n_unresolved): what folding recovered, and what it could not look into."""
    fresh = recovered_edges(edge, folded).agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_atoms"))
    kinds = classes.agg(F.count_if(F.col("class") == "foldable").alias("n_foldable"), F.count_if(F.col("class") == "unresolved").alias("n_unresolved"))
    return fresh.withColumn("one", F.lit(1)).join(kinds.withColumn("one", F.lit(1)), "one").drop("one")


def fold_closure(edge: DataFrame, foldable: DataFrame, emitted: DataFrame) -> DataFrame:
    """(src, dst): emitted declarations that a foldable auxiliary reaches through foldable ones alone."""
    return closure_pairs(edge.select("src", "dst").distinct(), foldable, emitted)


def folded_edges(edge: DataFrame, closure: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst) to add to the hosts' term dependencies: what their auxiliaries reach, themselves excluded."""
    out = edge.select("src", F.col("dst").alias("aux")).distinct().join(sized(hosts.select(F.col("id").alias("src"))), "src", "left_semi")
    return out.join(sized(closure.select(F.col("src").alias("aux"), "dst")), "aux").where("src <> dst").select("src", "dst").distinct()


def recovered_edges(edge: DataFrame, folded: DataFrame) -> DataFrame:
    """Folded edges that the hosts' term dependencies lacked."""
    return folded.join(sized(edge.where("role = 'value'").select("src", "dst").distinct()), ["src", "dst"], "left_anti")


def merge_classes(version: DataFrame) -> DataFrame:
    """(name, class, modules) of names that project modules declare more than once or that also exist outside.

    ``version`` has (name, module, in_project). A name that any outside module declares is
    ``cross``; one with two project versions or more is ``merged``; modules are sorted and
    those of the project alone.
    """
    out = version.groupBy("name").agg(
        F.bool_or(~F.col("in_project")).alias("outside"),
        F.array_sort(F.collect_set(F.when(F.col("in_project"), F.col("module")))).alias("modules"),
    )
    kind = F.when(F.col("outside"), F.lit("cross")).when(F.size("modules") > 1, F.lit("merged"))
    return out.where(F.size("modules") > 0).select("name", kind.alias("class"), "modules").where("class IS NOT NULL")


def outside_edges(constant: DataFrame) -> DataFrame:
    """(src, dst) of the versions outside the project of names that several modules declare; ``constant`` has one row a version, with in_project."""
    several = constant.groupBy("name_id").agg(F.count_distinct("module").alias("n")).where("n > 1").select("name_id")
    return constant_edges(constant.where("NOT in_project").join(sized(several), "name_id", "left_semi")).select("src", "dst").distinct()


def axiom_versions(constant: DataFrame) -> DataFrame:
    """Ids of names that several modules declare, one of them as an axiom."""
    x = constant.groupBy(F.col("name_id").alias("id")).agg(F.count_distinct("module").alias("n"), F.bool_or(F.col("ctor_kind") == "axiom").alias("axiom"))
    return x.where("n > 1 AND axiom").select("id")


def duplicate_versions(version: DataFrame) -> DataFrame:
    """(name, n_versions, axiom_version) of names declared twice or more in any module (version: name, module, ctor_kind)."""
    out = version.groupBy("name").agg(F.count_distinct("module").alias("n_versions"), F.bool_or(F.col("ctor_kind") == "axiom").alias("axiom_version"))
    return out.where("n_versions > 1")


def coimport_collisions(version: DataFrame) -> DataFrame:
    """Names of which two modules hold versions that neither can stand for the other's.

    ``version`` has (name, module, ctor_kind, type_hash, level_params, all_names,
    is_unsafe). Versions that agree in what subsumption looks at are alike, so each kind
    of version is compared once: a name has few kinds however many modules repeat it.
    """
    shape = version.select("name", "module", "ctor_kind", "type_hash", "level_params", "all_names", "is_unsafe")
    kinds = shape.groupBy("name", "ctor_kind", "type_hash", "level_params", "all_names", "is_unsafe").agg(F.min("module").alias("module"), F.count_distinct("module").alias("n"))
    a, b = kinds.alias("a"), kinds.alias("b")
    pairs = a.join(sized(b), (F.col("a.name") == F.col("b.name")) & (F.col("a.module") <= F.col("b.module")))
    clash = pairs.where((F.col("a.module") < F.col("b.module")) | (F.col("a.n") > 1)).where(~subsumes("a", "b") & ~subsumes("b", "a"))
    return clash.select(F.col("a.name").alias("name")).distinct()


def subsumes(a: str, b: str) -> Column:
    """Whether version ``a`` can stand for version ``b``."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = (x("type_hash") == y("type_hash")) & x("level_params").eqNullSafe(y("level_params"))
    theorem, axiom = x("ctor_kind") == "thm", x("ctor_kind") == "axiom"
    to_theorem = theorem & (y("ctor_kind") == "thm") & x("all_names").eqNullSafe(y("all_names"))
    to_axiom = theorem & (y("ctor_kind") == "axiom") & x("all_names").eqNullSafe(F.array(x("name"))) & ~y("is_unsafe")
    return same & (to_theorem | to_axiom | (axiom & (y("ctor_kind") == "axiom") & (x("is_unsafe") == y("is_unsafe"))))


def merged_location(version: DataFrame) -> DataFrame:
    """(name, module, range_start, range_end) where a name is shown: its owner if that is selected and has a range, else the first such module.

    ``version`` has (name, module, owner_module, selected, range_start, range_end), project versions alone.
    """
    fit = version.where("selected AND range_start IS NOT NULL")
    order = F.struct((F.col("module") != F.col("owner_module")).alias("other"), "module")
    first = fit.groupBy("name").agg(F.min_by(F.struct("module", "range_start", "range_end"), order).alias("_place"))
    return first.select("name", "_place.*")


def example_module(collision: DataFrame) -> DataFrame:
    """(name, module): of the modules (name, module) that declare a name, the first that isn't above another of them, else the first."""
    a, b = collision.select("name", "module"), collision.select("name", F.col("module").alias("other"))
    above = a.join(b, "name").groupBy("name", "module").agg(F.bool_or(F.col("other").startswith(F.concat("module", F.lit(".")))).alias("above"))
    return above.groupBy("name").agg(F.min_by("module", F.struct("above", "module")).alias("module"))


def displayable(name: Column) -> Column:
    """Whether a clash of this name is worth showing: not a compiler's own name, not a hygienic one."""
    return ~(F.exists(F.split(name, r"\."), lambda x: x.startswith("_")) | name.contains("._hyg"))


def declaring_modules(version: DataFrame, name: str) -> DataFrame:
    return version.where(F.col("name") == name).select("module").distinct()


def already_contained(message: Column) -> Column:
    """The name in an importer's message ``already contains 'X' from``; X may hold quotes. Null if there is none."""
    return F.nullif(F.regexp_extract(message, r"(?s)already contains '(.+?)' from ", 1), F.lit(""))


def import_closure(module: DataFrame, module_import: DataFrame, targets: DataFrame) -> DataFrame:
    """Modules of the build folder (module) reached from ``targets`` (module) over imports, which are written once for all levels; those outside aren't followed."""
    inside = module.where("in_build_dir").select("module")
    edge = module_import.join(sized(inside), "module", "left_semi").join(sized(inside.select(F.col("module").alias("imported"))), "imported", "left_semi")
    edge = written(edge.select(F.col("module").alias("src"), F.col("imported").alias("dst")), "imports")
    start = targets.join(sized(inside), "module", "left_semi").select(F.col("module").alias("id"))
    return reachable(edge, start).withColumnRenamed("id", "module")


def unresolved_imports(module: DataFrame, module_import: DataFrame) -> DataFrame:
    """(imported, module): imports that no known module answers, with the first importer."""
    return module_import.join(sized(module.select(F.col("module").alias("imported"))), "imported", "left_anti").groupBy("imported").agg(F.min("module").alias("module"))


def closure_problems(module: DataFrame, module_import: DataFrame, targets: DataFrame) -> DataFrame:
    """(module, problem, importer) that make an import closure unreadable.

    A module of the closure imports one that nothing answers, a target is unknown, or a
    target lies outside the build folder.
    """
    known = module.select("module")
    module_import = written(module_import.select("module", "imported"), "imports")
    closure = import_closure(module, module_import, targets)
    lost = unresolved_imports(module, module_import.join(sized(closure), "module", "left_semi")).select(F.col("imported").alias("module"), F.lit("unresolved").alias("problem"), F.col("module").alias("importer"))
    none = F.lit(None).cast("string")
    unknown = targets.select("module").distinct().join(sized(known), "module", "left_anti").select("module", F.lit("unresolved"), none)
    outside = targets.select("module").distinct().join(sized(module.where("NOT in_build_dir").select("module")), "module", "left_semi").select("module", F.lit("outside the build folder"), none)
    return lost.union(unknown).union(outside)


def loaded_differences(loaded: DataFrame, project: DataFrame, in_build_dir: DataFrame) -> DataFrame:
    """(module, problem): project modules that an import didn't load, and loaded modules of the build folder that the closure lacks."""
    absent = project.select("module").distinct().join(loaded.select("module"), "module", "left_anti").withColumn("problem", F.lit("not loaded"))
    extra = loaded.select("module").distinct().join(in_build_dir.select("module"), "module", "left_semi").join(project.select("module"), "module", "left_anti")
    return absent.union(extra.withColumn("problem", F.lit("not in the closure")))


def missing_builds(import_set: DataFrame, built: DataFrame) -> DataFrame:
    """Modules to import that have no compiled file."""
    return import_set.select("module").distinct().join(built.select("module"), "module", "left_anti")


def dependency_roots(module: DataFrame, project: DataFrame) -> DataFrame:
    """The first name parts of the modules that aren't the project's."""
    outside = module.join(sized(project.select("module")), "module", "left_anti")
    return outside.select(F.element_at(F.split("module", r"\."), 1).alias("root")).distinct()


def ownership(owner: DataFrame, imported: DataFrame, target_roots: DataFrame) -> DataFrame:
    """(module, verdict) from who claims a module (module, lib, exe)."""
    flag = lambda df, name: df.select("module", F.lit(True).alias(name)).distinct()
    x = owner.join(flag(imported, "i"), "module", "left").join(flag(target_roots, "r"), "module", "left")
    lib, exe = F.col("lib").isNotNull(), F.col("exe").isNotNull()
    verdict = F.when(lib & exe, "libAndExe").when(lib, "ok").when(~exe, "unowned").when(F.col("i"), "exeImported").when(F.col("r"), "ok").otherwise("internal")
    return x.select("module", verdict.alias("verdict"))


def owners_exact_cover(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """(module, n_asked, n_answered) where the answers don't cover the requests exactly once."""
    a = asked.groupBy("module").agg(F.count("*").alias("n_asked"))
    b = answered.groupBy("module").agg(F.count("*").alias("n_answered"))
    x = a.join(b, "module", "full").select("module", F.coalesce("n_asked", F.lit(0)).alias("n_asked"), F.coalesce("n_answered", F.lit(0)).alias("n_answered"))
    return x.where("n_asked <> 1 OR n_answered <> 1")


def emitted_modules(project: DataFrame, import_set: DataFrame, owned: DataFrame | None, narrow: bool) -> DataFrame:
    """Modules whose declarations are shown: the narrowed import set; or, with libraries chosen, the project's part of what they import or own; else the project."""
    if narrow:
        return import_set.select("module").distinct()
    if owned is None:
        return project.select("module").distinct()
    return project.select("module").distinct().join(import_set.select("module").union(owned.select("module")).distinct(), "module", "left_semi")


def spec_sources(atom: DataFrame) -> DataFrame:
    """Theorems that may specify something: not generated, unless marked primary."""
    generated = F.col("is_lean_generated") | F.col("is_aeneas_generated")
    return atom.where((F.col("kind") == "theorem") & (~generated | F.col("is_primary_spec")))


def spec_targets(atom: DataFrame) -> DataFrame:
    plain = ~(F.coalesce("is_proof", F.lit(True)) | F.col("codomain_is_prop") | F.col("codomain_is_type"))
    return atom.where(F.col("kind").isin(SPEC_TARGET_KINDS) & plain)


def specs(atom: DataFrame, type_edge: DataFrame, any_edge: DataFrame) -> DataFrame:
    """(target, source): each target with the theorems whose statement names it.

    A tagged theorem whose statement names no target takes the only target among all of
    its dependencies.
    """
    source, target = spec_sources(atom).select("id", "is_primary_spec"), spec_targets(atom).select(F.col("id").alias("dst"))
    stated = type_edge.select("src", "dst").distinct().join(sized(source.select(F.col("id").alias("src"))), "src", "left_semi").join(sized(target), "dst", "left_semi")
    tagged = source.where("is_primary_spec").select(F.col("id").alias("src")).join(sized(stated.select("src").distinct()), "src", "left_anti")
    other = any_edge.select("src", "dst").distinct().join(sized(tagged), "src", "left_semi").join(sized(target), "dst", "left_semi")
    sole = other.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst")
    return stated.select("src", "dst").union(sole).select(F.col("dst").alias("target"), F.col("src").alias("source")).distinct()


def primary_specs(spec: DataFrame, atom: DataFrame) -> DataFrame:
    """(target, source, rule): the specification that speaks for a target.

    Rule 1 takes a tagged theorem, the last by name if there are several. Rules 2 to 5
    each need exactly one match: a known attribute with no other program head, the name
    ``T_spec`` or ``T.spec``, the head with a name that ends in the last part's spec, and
    the only specification there is.
    """
    s = atom.select(F.col("id").alias("source"), F.col("name").alias("s_name"), "attributes", "step_program_head", "is_primary_spec")
    t = atom.select(F.col("id").alias("target"), F.col("name").alias("t_name"))
    x = spec.join(sized(s), "source").join(sized(t), "target")
    user, last = user_name(F.col("s_name")), last_part(F.col("t_name"))
    heads = F.col("step_program_head") == F.col("t_name")
    known = F.exists("attributes", lambda a: a.isin(SPEC_ATTRIBUTES))
    named = (user == F.concat("t_name", F.lit("_spec"))) | (user == F.concat("t_name", F.lit(".spec")))
    ends = user.endswith(F.concat(F.lit("."), last, F.lit(".spec"))) | (user == F.concat(last, F.lit(".spec"))) | (last_part(user) == F.concat(last, F.lit("_spec")))
    rules = {1: F.col("is_primary_spec"), 2: known & (F.col("step_program_head").isNull() | heads), 3: named, 4: F.coalesce(heads, F.lit(False)) & ends, 5: F.lit(True)}
    aggregates = []
    for k, rule in rules.items():
        matching = F.when(rule, F.struct("s_name", "source"))
        aggregates += [F.count(matching).alias(f"n{k}"), F.max(matching)["source"].alias(f"s{k}")]
    out = x.groupBy("target").agg(*aggregates)
    rule = F.when(F.col("n1") > 0, F.lit(1))
    for k in (2, 3, 4, 5):
        rule = rule.when(F.col(f"n{k}") == 1, F.lit(k))
    out = out.withColumn("rule", rule).where("rule IS NOT NULL")
    return out.select("target", F.element_at(F.array(*[F.col(f"s{k}") for k in rules]), F.col("rule")).alias("source"), "rule")


def ambiguous_primary_specs(spec: DataFrame, atom: DataFrame) -> DataFrame:
    """(target, n_tagged): targets with two tagged specifications or more."""
    tagged = atom.where("is_primary_spec").select(F.col("id").alias("source"))
    return spec.join(tagged, "source", "left_semi").groupBy("target").agg(F.count_distinct("source").alias("n_tagged")).where("n_tagged > 1")


def derived_instance_clusters(decl: DataFrame) -> DataFrame:
    """Ids (id) of instances strictly within the lines of an inductive, structure or class of their module, and of members under such an instance's name.

    A declaration lies in a type that begins above it and ends no earlier, or begins no
    later and ends below it: two running maxima over the lines of a module where
    anything begins, one row a line, so no type meets a declaration as a pair.
    """
    placed = decl.where("range_start IS NOT NULL")
    host = F.col("kind").isin("inductive", "structure", "class")
    line = placed.groupBy("module", "range_start").agg(F.max(F.when(host, F.col("range_end"))).alias("end"))
    so_far = Window.partitionBy("module").orderBy("range_start")
    above, upto = F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.select("module", "range_start", above.alias("above"), upto.alias("upto"))
    covered = placed.join(sized(line), ["module", "range_start"]).where("above >= range_end OR upto > range_end").select("id", "name", "kind", "module")
    instances = covered.where("kind = 'instance'")
    parts = F.split("name", r"\.")
    named = covered.select("name", "module").distinct()
    above = named.withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))))
    under = above.join(sized(instances.select(F.col("name").alias("ancestor"), "module").distinct()), ["ancestor", "module"], "left_semi").select("name", "module").distinct()
    members = covered.join(sized(under), ["name", "module"], "left_semi")
    return instances.select("id").union(members.select("id")).distinct()


def companion_theorems(decl: DataFrame) -> DataFrame:
    """Ids of theorems named ``X.mvcgen_spec`` whose ``X`` is unknown or a theorem."""
    own = decl.where((F.col("kind") == "theorem") & F.col("name").endswith(".mvcgen_spec"))
    own = own.select("id", F.regexp_replace("name", r"\.mvcgen_spec$", "").alias("parent"))
    parent = decl.groupBy(F.col("name").alias("parent")).agg(F.bool_and(F.col("kind") == "theorem").alias("fits"))
    return own.join(sized(parent), "parent", "left").where("fits IS NULL OR fits").select("id")


def view_atoms(atom: DataFrame) -> DataFrame:
    """Atoms that a view shows."""
    return atom.where("NOT is_hidden AND NOT is_lean_generated AND NOT is_aeneas_generated AND is_relevant").where(F.col("code_path").endswith("Funs.lean"))


def unique_keys(shown: DataFrame) -> DataFrame:
    """``shown`` with ``view_key``: path and last name part, or path and full name where that is taken more than once."""
    short = F.concat("code_path", F.lit("/"), last_part(F.col("code_name")))
    x = shown.withColumn("_short", short).withColumn("_n", F.count("*").over(Window.partitionBy("_short")))
    return x.withColumn("view_key", F.when(F.col("_n") > 1, F.concat("code_path", F.lit("/"), F.regexp_replace("code_name", "^probe:", ""))).otherwise(F.col("_short"))).drop("_short", "_n")


def molecules(keyed: DataFrame) -> DataFrame:
    """Molecule rows of a view; what only other tools know is left blank."""
    lines = F.when(F.col("lines_start").isNotNull(), F.concat_ws("-", F.col("lines_start").cast("string"), F.col("lines_end").cast("string")))
    return keyed.select("view_key", "code_path", lines.alias("code_lines"), "code_name", F.lit("").alias("rust_path"), F.lit(0).alias("rust_start"), F.lit(0).alias("rust_end"), F.lit("").alias("rust_name"), F.col("code_path").alias("spec_path"), F.lit(None).cast("string").alias("spec_lines"), F.col("code_name").alias("spec_name"))


def duplicate_names(atom: DataFrame) -> DataFrame:
    return atom.groupBy("code_name").agg(F.count("*").alias("n")).where("n > 1")


def within_prefix(module: DataFrame, prefix: str) -> DataFrame:
    """Modules that are ``prefix`` or lie under it."""
    return module.where((F.col("module") == prefix) | F.col("module").startswith(prefix + "."))
