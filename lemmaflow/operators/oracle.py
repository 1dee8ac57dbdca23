"""The catalog's questions as SQL over the star-schema tables, with recursive common table expressions for closures."""

from __future__ import annotations

from lemmaflow.sources import derived as D

# Endings of generated names and report categories, told here once more so that the queries' own lists are checked.
SUFFIXES = "noConfusionType noConfusion casesOn rec recOn brecOn below ibelow binductionOn sizeOf_spec inj injEq mk.inj mk.injEq mk.sizeOf_spec eq_1 eq_2 eq_3 eq_def mk elim ctorIdx toCtorIdx".split()
CATEGORIES = "sorry,bv_decide,native_decide,universe-typed,project axiom,dependency axiom,trusted".split(",")
SUFFIX_TEST = "(" + " OR ".join(f"ends_with(name, '.{s}')" for s in SUFFIXES) + ")"
INTERNAL = f"(starts_with(name, '_') OR contains(name, '._') OR contains(name, '[') OR contains(name, 'proof_') OR contains(name, 'match_') OR {SUFFIX_TEST})"
STANDARD = "(17, 37, 57, 77, 97)"

#: Named pieces; each names the pieces it needs.
PIECES = {
    "decl": ([], D.DECL.format(part="part")),
    "edge": ([], D.EDGE.format(part="part", lineitem="lineitem")),
    "version": ([], D.VERSION.format(part="part")),
    "module": ([], D.MODULE.format(supplier="supplier")),
    "import": ([], D.IMPORT.format(lineitem="lineitem")),
    "trusted": (["decl"], "SELECT * FROM (SELECT id, CASE WHEN kind = 'axiom' THEN 'axiom' WHEN tagged THEN 'externally_verified' WHEN module_external AND NOT type_is_prop THEN 'external' END AS reason FROM decl WHERE in_project) WHERE reason IS NOT NULL"),
    "walk": (["edge", "decl", "trusted"], "SELECT e.src, e.dst, e.role FROM edge e JOIN decl d ON d.id = e.src AND d.in_project LEFT JOIN trusted t ON t.id = e.src WHERE t.id IS NULL OR e.role <> 'value'"),
    "direct": (["walk"], "SELECT DISTINCT src AS id FROM walk WHERE dst = -1"),
    "taint": (["walk"], "SELECT src AS id FROM walk WHERE dst = -1 UNION SELECT w.src FROM walk w JOIN taint ON w.dst = taint.id"),
    "verdict": (["decl", "trusted", "taint", "direct"], "SELECT decl.id, CASE WHEN NOT decl.in_project THEN NULL WHEN direct.id IS NOT NULL THEN 'direct' WHEN taint.id IS NOT NULL THEN 'tainted' WHEN trusted.id IS NOT NULL THEN 'trusted' ELSE 'clean' END AS verdict, trusted.reason AS why FROM decl LEFT JOIN trusted ON trusted.id = decl.id LEFT JOIN taint ON taint.id = decl.id LEFT JOIN direct ON direct.id = decl.id"),
    "status": (["verdict"], "SELECT id, CASE verdict WHEN 'trusted' THEN 'trusted' WHEN 'direct' THEN 'unverified' WHEN 'tainted' THEN 'verified' WHEN 'clean' THEN 'transitively-verified' END AS status, CASE WHEN verdict = 'trusted' THEN why END AS reason, CASE WHEN verdict = 'tainted' THEN 'kernel-taint' END AS origin FROM verdict"),
    "usable": (["edge", "decl", "trusted"], "SELECT DISTINCT e.src, e.dst, t.id IS NOT NULL AND e.role = 'value' AS vouches FROM edge e JOIN decl d ON d.id = e.src LEFT JOIN trusted t ON t.id = e.src WHERE (e.role <> 'value' OR d.kind <> 'axiom') AND NOT (d.id IN " + STANDARD + " AND NOT d.in_project)"),
    "pairs": (["usable"], "SELECT id, id AS label FROM decl WHERE kind = 'axiom' AND NOT (id IN " + STANDARD + " AND NOT in_project) UNION SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) UNION SELECT u.src, CASE WHEN u.vouches AND p.label = -1 THEN u.src ELSE p.label END FROM usable u JOIN pairs p ON u.dst = p.id"),
    "category": (["decl", "trusted"], "SELECT decl.id, CASE WHEN kind = 'axiom' THEN CASE WHEN known_attribute THEN 'bv_decide' WHEN is_aeneas_generated THEN 'native_decide' WHEN carrier THEN 'universe-typed' WHEN in_project THEN 'project axiom' ELSE 'dependency axiom' END WHEN reason IS NOT NULL THEN 'trusted (' || reason || ')' ELSE 'unknown' END AS category FROM decl LEFT JOIN trusted ON trusted.id = decl.id UNION ALL SELECT -1, 'sorry'"),
    "report": (["pairs", "category", "decl"], "SELECT label, category, n FROM (SELECT label, count(*) AS n FROM pairs WHERE pairs.id IN (SELECT id FROM decl WHERE in_project) GROUP BY label) JOIN category ON category.id = label"),
    "closure": (["edge", "decl"], "SELECT e.src, e.dst FROM edge e JOIN decl a ON a.id = e.src AND a.aux AND a.kind <> 'axiom' JOIN decl b ON b.id = e.dst AND NOT b.aux UNION SELECT e.src, c.dst FROM edge e JOIN decl a ON a.id = e.src AND a.aux AND a.kind <> 'axiom' JOIN closure c ON c.src = e.dst"),
    "folded": (["closure", "edge", "decl"], "SELECT DISTINCT e.src, c.dst FROM edge e JOIN closure c ON c.src = e.dst JOIN decl h ON h.id = e.src AND NOT h.aux WHERE e.src <> c.dst"),
    "merges": (["version"], "SELECT name, bool_or(NOT in_project) AS outside, string_agg(DISTINCT CASE WHEN in_project THEN module END, ',' ORDER BY CASE WHEN in_project THEN module END) AS modules, count(DISTINCT CASE WHEN in_project THEN module END) AS n FROM version GROUP BY name"),
    "spec": (
        ["decl", "edge"],
        "WITH source AS (SELECT id, is_primary_spec FROM decl WHERE kind = 'theorem' AND (NOT (is_lean_generated OR is_aeneas_generated) OR is_primary_spec)), target AS (SELECT id FROM decl WHERE kind IN ('def', 'abbrev', 'instance', 'opaque', 'axiom') AND NOT type_is_prop),"
        " stated AS (SELECT DISTINCT e.src, e.dst FROM edge e JOIN source ON source.id = e.src JOIN target ON target.id = e.dst WHERE e.role = 'type'),"
        " sole AS (SELECT src, min(dst) AS dst FROM (SELECT DISTINCT e.src, e.dst FROM edge e JOIN source ON source.id = e.src AND source.is_primary_spec JOIN target ON target.id = e.dst WHERE e.src NOT IN (SELECT src FROM stated)) GROUP BY src HAVING count(*) = 1)"
        " SELECT dst AS target, src AS source FROM stated UNION SELECT dst, src FROM sole",
    ),
    "imported": (["module", "import"], "SELECT module FROM module WHERE in_build_dir AND is_target UNION SELECT i.imported FROM import i JOIN imported c ON c.module = i.module JOIN module m ON m.module = i.imported AND m.in_build_dir"),
    "imported_narrow": (["module", "import"], "SELECT module FROM module WHERE in_build_dir AND s_nationkey % 2 = 1 AND starts_with(module, 'L3.') UNION SELECT i.imported FROM import i JOIN imported_narrow c ON c.module = i.module JOIN module m ON m.module = i.imported AND m.in_build_dir AND m.s_nationkey % 2 = 1"),
    "shown": (["decl"], "SELECT *, code_path || '/' || regexp_extract(code_name, '[^.]*$') AS short FROM decl WHERE NOT is_hidden AND NOT is_lean_generated AND NOT is_aeneas_generated AND is_relevant AND ends_with(code_path, 'Funs.lean')"),
    "keyed": (["shown"], "SELECT *, CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN code_path || '/' || replace(code_name, 'probe:', '') ELSE short END AS view_key FROM shown"),
    "reported": (["status"], "SELECT id, CASE WHEN id % 50 = 0 THEN 'failed' ELSE status END AS status FROM status WHERE id % 77 <> 0"),
    "probed": (["status"], "SELECT id, CASE WHEN id % 40 = 0 THEN 'verified' ELSE status END AS status, origin FROM status"),
    "scanned": (
        ["decl"],
        "SELECT id, list_sort(list_distinct(list_concat(CASE WHEN tagged THEN ['externally_verified'] ELSE [] END, CASE WHEN is_primary_spec THEN ['primary_spec'] ELSE [] END, CASE id % 6 WHEN 0 THEN ['simp', 'step'] WHEN 1 THEN ['ext'] WHEN 2 THEN ['externally_verified', 'progress'] WHEN 3 THEN ['externally_verified'] WHEN 4 THEN [] ELSE ['externally_verified', 'step'] END))) AS names, id % 6 IN (2, 3, 5) AS shows_tag, id % 6 = 2 OR id % 12 = 3 AS names_tag FROM decl",
    ),
    "fold_class": (
        ["edge", "decl"],
        f"SELECT n.id, CASE WHEN name IS NULL THEN 'unresolved' WHEN {INTERNAL} OR (in_project AND lines_start IS NULL) THEN CASE WHEN NOT {SUFFIX_TEST} AND ctor_kind IN ('defn', 'thm', 'opaque') THEN 'foldable' ELSE 'ignored' END WHEN in_project THEN 'emitted' ELSE 'ignored' END AS class FROM (SELECT dst AS id FROM edge UNION SELECT src + 1000000000 FROM edge WHERE src % 10 = 3) n LEFT JOIN decl ON decl.id = n.id",
    ),
    "recovered": (["folded", "edge"], "SELECT src, dst FROM folded EXCEPT SELECT src, dst FROM edge WHERE role = 'value'"),
    "location": ([], D.LOCATION.format(part="part")),
    "spec_atom": ([], D.SPEC_ATOM.format(part="part")),
    "spec_relation": ([], D.SPEC_RELATION.format(part="part")),
    "known": (["module"], "SELECT * FROM module WHERE s_nationkey <> 3"),
    "reach_known": (["known", "import"], "SELECT module FROM known WHERE in_build_dir AND is_target UNION SELECT i.imported FROM import i JOIN reach_known c ON c.module = i.module JOIN known m ON m.module = i.imported AND m.in_build_dir"),
    "used_aux": (
        ["edge", "decl"],
        "SELECT DISTINCT e.src, e.dst AS aux, CASE WHEN regexp_matches(l, '^_?proof_') THEN '_proof_N' WHEN l = 'mk' THEN '.mk' WHEN regexp_matches(l, '^eq_[0-9]*$') THEN '.eq_N' WHEN starts_with(l, '_') THEN 'other _prefixed (' || regexp_replace(l, '[0-9]+$', '') || ')' ELSE 'other (' || regexp_replace(l, '[0-9]+$', '') || ')' END AS shape FROM edge e JOIN decl h ON h.id = e.src AND NOT h.aux JOIN (SELECT id, regexp_extract(name, '[^.]*$') AS l FROM decl WHERE aux) a ON a.id = e.dst",
    ),
    "arrays": (
        ["edge", "decl"],
        "SELECT id, coalesce(t, []) AS t, coalesce(v, []) AS v, list_sort(list_distinct(list_concat(coalesce(t, []), coalesce(v, [])))) AS d FROM (SELECT decl.id, list_sort(list(DISTINCT 'probe:' || dst) FILTER (role = 'type')) AS t, list_sort(list(DISTINCT 'probe:' || dst) FILTER (role = 'value')) AS v FROM decl LEFT JOIN edge ON edge.src = decl.id WHERE NOT aux GROUP BY decl.id)",
    ),
    "arrays_after": (
        ["arrays", "folded"],
        "SELECT id, t, v, CASE WHEN id % 70 = 2 THEN d[:greatest(len(d) - 1, 0)] ELSE d END AS d FROM (SELECT id, t, v, list_sort(list_distinct(list_concat(t, v))) AS d FROM (SELECT id, CASE WHEN id % 50 = 0 THEN list_append(t, 'probe:zz') ELSE t END AS t, CASE WHEN id % 60 = 1 THEN v[2:] ELSE v END AS v FROM (SELECT a.id, a.t, list_sort(list_distinct(list_concat(a.v, coalesce(f.f, [])))) AS v FROM arrays a LEFT JOIN (SELECT src, list('probe:' || dst) AS f FROM folded GROUP BY src) f ON f.src = a.id)))",
    ),
    "c_edge": (["edge", "decl"], "SELECT e.* FROM edge e JOIN decl d ON d.id = e.src WHERE e.role = 'type' OR d.kind NOT IN ('structure', 'axiom')"),
    "c_walk": (["c_edge", "decl", "trusted"], "SELECT e.src, e.dst FROM c_edge e JOIN decl d ON d.id = e.src AND d.in_project LEFT JOIN trusted t ON t.id = e.src WHERE t.id IS NULL OR e.role <> 'value'"),
    "c_taint": (["c_walk"], "SELECT src AS id FROM c_walk WHERE dst = -1 UNION SELECT w.src FROM c_walk w JOIN c_taint ON w.dst = c_taint.id"),
    "c_closure": (["c_edge", "decl"], "SELECT e.src, e.dst FROM c_edge e JOIN decl a ON a.id = e.src AND a.aux AND a.in_project AND a.kind NOT IN ('structure', 'axiom') JOIN decl b ON b.id = e.dst AND NOT b.aux AND b.in_project UNION SELECT e.src, c.dst FROM c_edge e JOIN decl a ON a.id = e.src AND a.aux AND a.in_project AND a.kind NOT IN ('structure', 'axiom') JOIN c_closure c ON c.src = e.dst"),
    "c_deps": (["c_edge", "c_closure", "decl"], "SELECT DISTINCT src, dst, role, dst = -1 OR dst NOT IN (SELECT id FROM decl WHERE in_project) AS out FROM (SELECT src, dst, role FROM c_edge UNION SELECT e.src, c.dst, 'value' FROM c_edge e JOIN c_closure c ON c.src = e.dst WHERE e.src <> c.dst)"),
    "c_spec": (
        ["c_deps", "decl"],
        "WITH source AS (SELECT id, is_primary_spec FROM decl WHERE kind = 'theorem' AND NOT aux AND in_project), target AS (SELECT id FROM decl WHERE kind IN ('def', 'abbrev', 'axiom') AND NOT type_is_prop AND NOT aux AND in_project),"
        " stated AS (SELECT DISTINCT e.src, e.dst FROM c_deps e JOIN source ON source.id = e.src JOIN target ON target.id = e.dst WHERE e.role = 'type'),"
        " sole AS (SELECT src, min(dst) AS dst FROM (SELECT DISTINCT e.src, e.dst FROM c_deps e JOIN source ON source.id = e.src AND source.is_primary_spec JOIN target ON target.id = e.dst WHERE e.src NOT IN (SELECT src FROM stated)) GROUP BY src HAVING count(*) = 1)"
        " SELECT dst AS target, src AS source FROM stated UNION SELECT dst, src FROM sole",
    ),
    "c_first": (["c_spec", "decl"], "SELECT target, CASE WHEN count(*) FILTER (is_primary_spec) > 0 THEN arg_max(source, 'N' || source) FILTER (is_primary_spec) WHEN count(*) = 1 THEN max(source) END AS source FROM c_spec JOIN decl ON decl.id = source GROUP BY target"),
    "hit": (["probed", "edge"], "SELECT id FROM probed WHERE status IN ('unverified', 'failed') UNION SELECT e.src FROM edge e JOIN hit ON hit.id = e.dst JOIN probed p ON p.id = e.src AND p.status IN ('verified', 'transitively-verified')"),
}


def needs(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            needs(PIECES[n][0], seen)
            seen.append(n)
    return seen


def ask(select: str, *names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f'"{n}" AS ({PIECES[n][1]})' for n in needs(list(names), [])) + " " + select


LAST = "regexp_extract(name, '[^.]*$')"
TARGET_LAST = "regexp_extract(t.name, '[^.]*$')"


#: What a report lists, beside what the atoms say.
COMPARED = (
    ", listed AS (SELECT d.id, coalesce(v.verdict, '') = 'direct' OR d.id % 37 = 5 AND NOT (coalesce(v.verdict, '') IN ('direct', 'tainted') AND d.id % 31 <> 0) AS direct, NOT d.aux AND d.id % 41 <> 0 AS emitted FROM decl d JOIN verdict v ON v.id = d.id WHERE (v.verdict IN ('direct', 'tainted') AND d.id % 31 <> 0) OR d.id % 37 = 5),"
    " x AS (SELECT coalesce(a.id, l.id) AS id, a.id IS NOT NULL AS here, l.id IS NOT NULL AS there, coalesce(l.direct, false) AS direct, l.emitted, a.status, a.origin FROM (SELECT status.* FROM status JOIN decl ON decl.id = status.id AND NOT decl.aux) a FULL JOIN listed l ON l.id = a.id)"
)
DISAGREE = (
    " SELECT id::VARCHAR AS name, 'no status' AS problem FROM x WHERE here AND status IS NULL"
    " UNION ALL SELECT id::VARCHAR, 'listed, but the origin says otherwise' FROM x WHERE here AND status IS NOT NULL AND there AND NOT direct AND origin IS NULL"
    " UNION ALL SELECT id::VARCHAR, 'an origin, but not listed as tainted' FROM x WHERE here AND origin IS NOT NULL AND NOT (there AND NOT direct)"
    " UNION ALL SELECT id::VARCHAR, 'trusted, but listed' FROM x WHERE status = 'trusted' AND there"
    " UNION ALL SELECT id::VARCHAR, 'unverified, but not listed as direct' FROM x WHERE status = 'unverified' AND NOT (there AND direct)"
    " UNION ALL SELECT id::VARCHAR, 'verified, but listed as direct' FROM x WHERE status = 'verified' AND there AND direct"
    " UNION ALL SELECT id::VARCHAR, 'verified, but not listed' FROM x WHERE status = 'verified' AND NOT there"
    " UNION ALL SELECT id::VARCHAR, 'transitively verified, but listed' FROM x WHERE status = 'transitively-verified' AND there"
    " UNION ALL SELECT id::VARCHAR, 'listed as shown, but no atom' FROM x WHERE there AND emitted AND NOT here"
    " UNION ALL SELECT id::VARCHAR, 'listed as not shown, but an atom' FROM x WHERE there AND NOT emitted AND here"
)


def questions() -> dict[str, str]:
    return {
        "decl_kind": ask("SELECT id, CASE ctor_kind WHEN 'defn' THEN CASE WHEN is_aeneas_generated THEN 'instance' WHEN known_attribute THEN 'projection' WHEN carrier THEN 'abbrev' ELSE 'def' END WHEN 'thm' THEN CASE WHEN known_attribute THEN 'projection' ELSE 'theorem' END WHEN 'induct' THEN CASE WHEN tagged THEN 'class' WHEN aux THEN 'structure' ELSE 'inductive' END ELSE ctor_kind END AS kind FROM decl", "decl"),
        "internal_name_filter": ask(f"SELECT id, starts_with(name, '_') OR contains(name, '._') OR contains(name, '[') OR contains(name, 'proof_') OR contains(name, 'match_') OR {SUFFIX_TEST} AS is_internal, {SUFFIX_TEST} AS is_structural, regexp_matches({LAST}, '^(eq_def|eq_unfold|congr_simp|(eq|congr|hcongr|congr_eq)_[0-9]+)$') AS is_realised FROM decl", "decl"),
        "emitted_decls": ask(f"SELECT id, name FROM decl WHERE NOT (starts_with(name, '_') OR contains(name, '._') OR contains(name, '[') OR contains(name, 'proof_') OR contains(name, 'match_') OR {SUFFIX_TEST}) AND lines_start IS NOT NULL", "decl"),
        "display_name": ask(f"SELECT id, {LAST} AS display_name, replace(code_name, 'probe:', '') AS bare_name, replace(module, '.', '/') || '.lean' AS path FROM decl", "decl"),
        "trusted_base": ask("SELECT id, reason FROM trusted", "trusted"),
        "trust_reason_counts": ask("SELECT reason, count(*) AS n FROM trusted GROUP BY reason", "trusted"),
        "rule3_candidates": ask("SELECT id, carrier OR type_is_prop AS counts_as_proof FROM decl WHERE ends_with(module, 'External') AND ctor_kind <> 'thm' AND kind <> 'axiom'", "decl"),
        "merged_trust": ask("SELECT name AS id, arg_min(r, module) AS reason FROM (SELECT name, module, CASE WHEN kind = 'axiom' THEN 'axiom' WHEN module_external AND NOT type_is_prop THEN 'external' END AS r FROM version WHERE in_project) GROUP BY name HAVING bool_and(r IS NOT NULL)", "version"),
        "walk_edges": ask("SELECT src, dst, role FROM walk", "walk"),
        "statement_edges": ask("SELECT DISTINCT src, dst FROM edge WHERE role = 'type'", "edge"),
        "proof_edges": ask("SELECT DISTINCT src, dst FROM edge WHERE role = 'value'", "edge"),
        "dependency_union": ask("SELECT src, coalesce(string_agg(DISTINCT CASE WHEN role = 'type' THEN dst END, ',' ORDER BY CASE WHEN role = 'type' THEN dst END), '') AS type_deps, coalesce(string_agg(DISTINCT CASE WHEN role = 'value' THEN dst END, ',' ORDER BY CASE WHEN role = 'value' THEN dst END), '') AS term_deps, string_agg(DISTINCT dst, ',' ORDER BY dst) AS deps FROM edge GROUP BY src", "edge"),
        "external_split": ask("SELECT src, dst, role, NOT EXISTS (SELECT 1 FROM decl d WHERE d.id = dst AND d.id % 20 <> 13) AS external FROM edge WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.id = dst AND d.aux)", "edge", "decl"),
        "direct_carriers": ask("SELECT id FROM direct", "direct"),
        "tainted": ask("SELECT id FROM taint", "taint"),
        "verification_status": ask("SELECT id, status, reason, origin FROM status", "status"),
        "status_skip_enrich": ask("SELECT id, CASE status WHEN 'transitively-verified' THEN 'verified' ELSE status END AS status, reason, origin FROM status", "status"),
        "status_skip_verify": ask("SELECT id, CASE WHEN verdict = 'trusted' THEN 'trusted' END AS status, CASE WHEN verdict = 'trusted' THEN why END AS reason, CAST(NULL AS VARCHAR) AS origin FROM verdict", "verdict"),
        "status_counts": ask("SELECT count(*) FILTER (status = 'transitively-verified') AS n_transitive, count(*) FILTER (status = 'verified') AS n_local, count(*) FILTER (status IS NULL OR status NOT IN ('transitively-verified', 'verified')) AS n_other FROM status", "status"),
        "unhide_contaminated": ask("SELECT decl.id, is_hidden AND NOT ((is_lean_generated OR is_aeneas_generated) AND coalesce(status IN ('verified', 'unverified', 'failed'), false)) AS is_hidden FROM decl JOIN status ON status.id = decl.id", "decl", "status"),
        "assumption_sets": ask("SELECT id, label FROM pairs", "pairs"),
        "assumption_report": ask("SELECT label, category, n FROM report", "report"),
        "assumption_category_counts": ask("SELECT place, category, coalesce(n_labels, 0) AS n_labels FROM (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CATEGORIES)) + ") o(place, category) LEFT JOIN (SELECT CASE WHEN starts_with(category, 'trusted') THEN 'trusted' ELSE category END AS c, count(*) AS n_labels FROM report GROUP BY 1) ON c = o.category", "report"),
        "fold_closure": ask("SELECT src, dst FROM closure", "closure"),
        "folded_term_deps": ask("SELECT src, dst FROM folded", "folded"),
        "fold_recovered_edges": ask("SELECT src, dst FROM folded EXCEPT SELECT src, dst FROM edge WHERE role = 'value'", "folded"),
        "merged_decls": ask("SELECT name, modules FROM merges WHERE NOT outside AND n > 1", "merges"),
        "cross_boundary": ask("SELECT name, modules FROM merges WHERE outside AND n > 0", "merges"),
        "duplicate_versions": ask("SELECT name, count(DISTINCT module) AS n_versions, bool_or(ctor_kind = 'axiom') AS axiom_version FROM version GROUP BY name HAVING count(DISTINCT module) > 1", "version"),
        "coimport_collisions": ask(
            "SELECT DISTINCT a.name FROM version a JOIN version b ON a.name = b.name AND a.module < b.module WHERE NOT (a.type_hash = b.type_hash AND ((a.ctor_kind = 'thm' AND b.ctor_kind = 'thm') OR (a.ctor_kind = 'thm' AND b.ctor_kind = 'axiom' AND NOT b.is_unsafe) OR (a.ctor_kind = 'axiom' AND b.ctor_kind = 'axiom' AND a.is_unsafe = b.is_unsafe)))"
            " AND NOT (a.type_hash = b.type_hash AND ((b.ctor_kind = 'thm' AND a.ctor_kind = 'thm') OR (b.ctor_kind = 'thm' AND a.ctor_kind = 'axiom' AND NOT a.is_unsafe) OR (b.ctor_kind = 'axiom' AND a.ctor_kind = 'axiom' AND a.is_unsafe = b.is_unsafe)))",
            "version",
        ),
        "specs": ask("SELECT target, source FROM spec", "spec"),
        "primary_spec": ask(
            f", x AS (SELECT target, source, s.name AS n, s.is_primary_spec AS r1, s.known_attribute AS r2, s.name = t.name || '_spec' OR s.name = t.name || '.spec' AS r3 FROM spec JOIN decl s ON s.id = source JOIN decl t ON t.id = target),"
            " g AS (SELECT target, count(*) FILTER (r1) AS n1, arg_max(source, (n, source)) FILTER (r1) AS s1, count(*) FILTER (r2) AS n2, max(source) FILTER (r2) AS s2, count(*) FILTER (r3) AS n3, max(source) FILTER (r3) AS s3, count(*) AS n5, max(source) AS s5 FROM x GROUP BY target)"
            " SELECT target, CASE WHEN n1 > 0 THEN s1 WHEN n2 = 1 THEN s2 WHEN n3 = 1 THEN s3 ELSE s5 END AS source, CASE WHEN n1 > 0 THEN 1 WHEN n2 = 1 THEN 2 WHEN n3 = 1 THEN 3 ELSE 5 END AS rule FROM g WHERE n1 > 0 OR n2 = 1 OR n3 = 1 OR n5 = 1",
            "spec",
            "decl",
        ),
        "primary_spec_rules": ask(
            f", x AS (SELECT target, source, s.name AS n, s.is_primary_spec AS r1, s.attribute IN ('step', 'progress', 'pspec') AND (s.head IS NULL OR s.head = t.name) AS r2, s.name IN (t.name || '_spec', t.name || '.spec') AS r3, coalesce(s.head = t.name, false) AND (ends_with(s.name, '.' || {TARGET_LAST} || '.spec') OR ends_with(s.name, '.' || {TARGET_LAST} || '_spec')) AS r4 FROM spec_relation JOIN spec_atom s ON s.id = source JOIN spec_atom t ON t.id = target),"
            " g AS (SELECT target, count(*) FILTER (r1) AS n1, arg_max(source, (n, source)) FILTER (r1) AS s1, count(*) FILTER (r2) AS n2, max(source) FILTER (r2) AS s2, count(*) FILTER (r3) AS n3, max(source) FILTER (r3) AS s3, count(*) FILTER (r4) AS n4, max(source) FILTER (r4) AS s4, count(*) AS n5, max(source) AS s5 FROM x GROUP BY target)"
            " SELECT target, CASE WHEN n1 > 0 THEN s1 WHEN n2 = 1 THEN s2 WHEN n3 = 1 THEN s3 WHEN n4 = 1 THEN s4 ELSE s5 END AS source, CASE WHEN n1 > 0 THEN 1 WHEN n2 = 1 THEN 2 WHEN n3 = 1 THEN 3 WHEN n4 = 1 THEN 4 ELSE 5 END AS rule FROM g WHERE n1 > 0 OR n2 = 1 OR n3 = 1 OR n4 = 1 OR n5 = 1",
            "spec_relation",
            "spec_atom",
        ),
        "ambiguous_primary_specs": ask("SELECT target, count(DISTINCT source) AS n_tagged FROM spec_relation JOIN spec_atom ON id = source AND is_primary_spec GROUP BY target HAVING count(DISTINCT source) > 1", "spec_relation", "spec_atom"),
        "derived_instance_clusters": ask(
            ", d AS (SELECT id, name, module, lines_start AS a, lines_end AS b, CASE WHEN is_aeneas_generated THEN 'instance' ELSE kind END AS kind FROM decl),"
            " covered AS (SELECT DISTINCT d.* FROM d JOIN d h ON h.module = d.module AND h.kind = 'structure' AND h.a <= d.a AND d.b <= h.b AND (h.a < d.a OR d.b < h.b))"
            " SELECT id FROM covered WHERE kind = 'instance' UNION SELECT c.id FROM covered c JOIN covered i ON i.kind = 'instance' AND i.module = c.module AND (c.name = i.name OR starts_with(c.name, i.name || '.'))",
            "decl",
        ),
        "companion_theorems": ask("SELECT id FROM decl WHERE kind = 'theorem' AND ends_with(name, '.mvcgen_spec') AND NOT EXISTS (SELECT 1 FROM decl p WHERE p.name = left(decl.name, length(decl.name) - 12) AND p.kind <> 'theorem')", "decl"),
        "import_closure": ask("SELECT module FROM imported", "imported"),
        "narrow_closure": ask("SELECT module FROM imported_narrow", "imported_narrow"),
        "unresolved_imports": ask("SELECT imported, min(module) AS module FROM import WHERE imported NOT IN (SELECT module FROM module WHERE s_nationkey <> 3) GROUP BY imported", "import", "module"),
        "ownership": ask("SELECT module, CASE WHEN s_nationkey % 12 = 0 THEN 'libAndExe' WHEN s_nationkey % 3 = 0 THEN 'ok' WHEN s_nationkey % 4 <> 0 THEN 'unowned' WHEN module IN (SELECT imported FROM import) THEN 'exeImported' WHEN is_target THEN 'ok' ELSE 'internal' END AS verdict FROM module", "module", "import"),
        "emitted_modules": ask("SELECT module FROM module WHERE in_build_dir AND (module IN (SELECT module FROM imported) OR s_nationkey % 3 = 0)", "module", "imported"),
        "module_prefix": ask("SELECT DISTINCT module FROM decl WHERE module = 'Pkg.M1' OR starts_with(module, 'Pkg.M1.')", "decl"),
        "owners_exact_cover": ask("SELECT module, CAST(1 AS BIGINT) AS n_asked, CAST(CASE s_nationkey WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS n_answered FROM module WHERE s_nationkey IN (3, 4)", "module"),
        "view_unique_keys": ask("SELECT id, view_key FROM keyed", "keyed"),
        "view_molecules": ask("SELECT view_key, code_path, CASE WHEN lines_start IS NOT NULL THEN lines_start || '-' || lines_end END AS code_lines, code_name, '' AS rust_path, 0 AS rust_start, 0 AS rust_end, '' AS rust_name, code_path AS spec_path, CAST(NULL AS VARCHAR) AS spec_lines, code_name AS spec_name FROM keyed", "keyed"),
        "duplicate_names": ask("SELECT code_name, count(*) AS n FROM decl GROUP BY code_name HAVING count(*) > 1", "decl"),
        "graph_check": ask("SELECT id, finding FROM (SELECT probed.id, CASE WHEN status = 'verified' AND origin IS NOT NULL THEN CASE WHEN hit.id IS NULL THEN 'reaches none' END WHEN status IN ('verified', 'transitively-verified') AND hit.id IS NOT NULL THEN 'reaches a failure' END AS finding FROM probed LEFT JOIN hit ON hit.id = probed.id) WHERE finding IS NOT NULL", "probed", "hit"),
        "missing_dependencies": ask("SELECT DISTINCT d.code_name AS name, regexp_replace(d.code_name, '\\.[^.]*$', '') IN (SELECT code_name FROM decl WHERE NOT aux AND kind = 'structure') AS is_member FROM edge JOIN decl d ON d.id = edge.dst WHERE d.code_name NOT IN (SELECT code_name FROM decl WHERE NOT aux)", "edge", "decl"),
        "in_degree_rescue": ask("SELECT dst AS id, count(*) AS n FROM folded WHERE dst NOT IN (SELECT e.dst FROM edge e JOIN decl d ON d.id = e.src AND NOT d.aux) GROUP BY dst", "folded"),
        "status_consistency": ask("SELECT s.id, s.status AS in_artifact, r.status AS in_report FROM status s LEFT JOIN reported r ON r.id = s.id WHERE s.status IS DISTINCT FROM r.status", "status", "reported"),
        "artifact_diff": ask(
            "SELECT id, change, change IN ('transitively-verified->verified', 'trusted->transitively-verified', 'unverified->verified') AS allowed FROM (SELECT s.id, CASE WHEN r.id IS NULL THEN 'removed' ELSE coalesce(s.status, 'none') || '->' || coalesce(r.status, 'none') END AS change FROM status s LEFT JOIN reported r ON r.id = s.id WHERE r.id IS NULL OR s.status IS DISTINCT FROM r.status)",
            "status",
            "reported",
        ),
        "attribute_scan": ask("SELECT id, array_to_string(names, ',') AS attributes, shows_tag, names_tag FROM scanned", "scanned"),
        "tag_audit": ask("SELECT id, finding FROM (SELECT d.id, CASE WHEN names_tag AND NOT tagged AND NOT ends_with(name, '.mvcgen_spec') AND NOT known_attribute THEN 'scan-only' WHEN tagged AND NOT shows_tag THEN 'tag-only' END AS finding FROM decl d JOIN scanned s ON s.id = d.id) WHERE finding IS NOT NULL", "decl", "scanned"),
        "head_lines": ask(
            f"SELECT code_path AS path, 4 * id + 1 + k AS line_no, k = 1 OR (k = 0 AND id % 6 = 5) AS is_head, CASE k WHEN 2 THEN '   exact x' WHEN 0 THEN CASE id % 6 WHEN 1 THEN ' ' WHEN 4 THEN 'private noncomputable' WHEN 5 THEN ' def elsewhere := 1' ELSE '' END ELSE CASE id % 6 WHEN 0 THEN 'theorem ' || {LAST} || ' : T' WHEN 1 THEN 'def ' || {LAST} || ' := ' WHEN 2 THEN ' private theorem ' || {LAST} || ' : T' WHEN 3 THEN 'instance : Foo' WHEN 4 THEN 'theorem other_name : T' ELSE ' def ' || {LAST} END END AS rest FROM decl, (VALUES (0), (1), (2)) v(k)",
            "decl",
        ),
        "fold_classes": ask("SELECT id, class FROM fold_class", "fold_class"),
        "fold_stats": ask("SELECT (SELECT count(*) FROM recovered) AS n_edges, (SELECT count(DISTINCT src) FROM recovered) AS n_atoms, count(*) FILTER (class = 'foldable') AS n_foldable, count(*) FILTER (class = 'unresolved') AS n_unresolved FROM fold_class", "fold_class", "recovered"),
        "fixpoint_bodies": ask("SELECT id FROM decl WHERE in_project AND id % 8 = 0 AND id % 16 <> 0", "decl"),
        "companion_heads": ask("SELECT d.id, CASE WHEN d.kind = 'axiom' THEN 'H' || d.id WHEN d.id % 2 = 1 AND p.kind = 'axiom' THEN 'H' || p.id END AS step_program_head FROM decl d LEFT JOIN decl p ON p.id = d.id - 1", "decl"),
        "merged_location": ask("SELECT name, module, range_start, range_end FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY module <> owner_module, module) AS k FROM location WHERE selected AND range_start IS NOT NULL) WHERE k = 1", "location"),
        "closure_problems": ask(
            "SELECT i.imported AS module, 'unresolved' AS problem, min(i.module) AS importer FROM import i JOIN reach_known r ON r.module = i.module WHERE i.imported NOT IN (SELECT module FROM known) GROUP BY i.imported UNION ALL SELECT module, 'unresolved', NULL FROM module WHERE is_target AND s_nationkey = 3 UNION ALL SELECT module, 'outside the build folder', NULL FROM known WHERE is_target AND NOT in_build_dir",
            "reach_known",
            "known",
        ),
        "loaded_differences": ask("SELECT module, 'not loaded' AS problem FROM imported WHERE module NOT IN (SELECT module FROM module WHERE s_nationkey % 7 <> 1) UNION ALL SELECT module, 'not in the closure' FROM module WHERE s_nationkey % 7 <> 1 AND in_build_dir AND module NOT IN (SELECT module FROM imported)", "imported"),
        "missing_builds": ask("SELECT module FROM imported WHERE module NOT IN (SELECT module FROM module WHERE s_nationkey % 6 <> 2)", "imported"),
        "dependency_roots": ask("SELECT DISTINCT 'R' || s_nationkey AS root FROM module WHERE NOT in_build_dir", "module"),
        "generated_axioms": ask(f"SELECT decl.id FROM trusted JOIN decl ON decl.id = trusted.id WHERE reason = 'axiom' AND ({INTERNAL} OR lines_start IS NULL)", "trusted", "decl"),
        "example_module": ask(", m AS (SELECT DISTINCT name, CASE WHEN type_hash IN ('h1', 'h2') THEN module || '.Sub' ELSE module END AS module FROM version) SELECT name, coalesce(min(module) FILTER (NOT above), min(module)) AS module FROM (SELECT a.name, a.module, bool_or(starts_with(b.module, a.module || '.')) AS above FROM m a JOIN m b ON b.name = a.name GROUP BY ALL) GROUP BY name", "version"),
        "already_contained": ask("SELECT id, CASE WHEN id % 3 > 0 THEN name || chr(39) END AS name FROM decl", "decl"),
        "shape_histogram": ask("SELECT shape, count(*) AS n, coalesce(sum(n_lost), 0)::BIGINT AS n_hidden, count(DISTINCT src) FILTER (n_lost > 0) AS n_hosts FROM (SELECT u.src, u.aux, u.shape, count(c.dst) AS n_lost FROM used_aux u LEFT JOIN closure c ON c.src = u.aux AND c.dst <> u.src AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = u.src AND e.dst = c.dst) GROUP BY ALL) GROUP BY shape", "used_aux", "closure"),
        "proof_carriers": ask("SELECT count(*) AS n_decls, count(*) FILTER (id IN (SELECT e.src FROM edge e JOIN decl a ON a.id = e.dst AND a.aux)) AS n_carriers FROM decl WHERE kind <> 'theorem'", "decl", "edge"),
        "hidden_by_position": ask(
            ", u AS (SELECT DISTINCT e.src, e.dst AS aux, e.role FROM edge e JOIN decl h ON h.id = e.src AND NOT h.aux WHERE e.dst IN (SELECT src FROM closure)), lost AS (SELECT DISTINCT u.role, u.src, c.dst FROM u JOIN closure c ON c.src = u.aux AND c.dst <> u.src WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = u.src AND e.dst = c.dst AND (u.role = 'value' OR e.role = 'type')))"
            " SELECT u.role, count(*) AS n_uses, (SELECT count(*) FROM lost WHERE lost.role = u.role) AS n_hidden FROM u GROUP BY u.role",
            "edge",
            "decl",
            "closure",
        ),
        "compare_artifacts": ask(
            ", x AS (SELECT 'probe:' || p.id AS name, p.t, p.v, p.d, n.t AS t2, n.v AS v2, n.d AS d2, s.status AS a, r.status AS b, r.id IS NULL AS gone FROM arrays p JOIN arrays_after n ON n.id = p.id JOIN status s ON s.id = p.id LEFT JOIN reported r ON r.id = p.id)"
            " SELECT 'atom removed' AS \"check\", name, CAST(NULL AS VARCHAR) AS detail FROM x WHERE gone"
            " UNION ALL SELECT c, name, f FROM (SELECT name, unnest([struct_pack(f := 'dependencies', o := d, n := d2), struct_pack(f := 'type-dependencies', o := t, n := t2), struct_pack(f := 'term-dependencies', o := v, n := v2)], recursive := true) FROM x WHERE NOT gone), (VALUES ('entries removed'), ('not a subsequence')) k(c) WHERE len(list_filter(o, lambda z: NOT list_contains(n, z))) > 0"
            " UNION ALL SELECT 'array changed', name, 'type-dependencies' FROM x WHERE NOT gone AND t <> t2"
            " UNION ALL SELECT 'not the union', name, NULL FROM x WHERE NOT gone AND list_sort(list_distinct(list_concat(t2, v2))) <> d2"
            " UNION ALL SELECT 'status moved', name, coalesce(a, 'none') || ' -> ' || coalesce(b, 'none') FROM x WHERE NOT gone AND a IS DISTINCT FROM b AND coalesce((a, b) NOT IN (('transitively-verified', 'verified'), ('trusted', 'transitively-verified'), ('unverified', 'verified')), true)",
            "arrays_after",
            "status",
            "reported",
        ),
        "added_dependencies": ask("SELECT a.id::VARCHAR AS atom, bucket, replace(target, 'probe:', '') AS target FROM (SELECT id, 'type' AS bucket, unnest(t) AS target FROM arrays_after UNION ALL SELECT id, 'term', unnest(v) FROM arrays_after) a JOIN reported USING (id) WHERE NOT EXISTS (SELECT 1 FROM arrays p WHERE p.id = a.id AND list_contains(CASE WHEN a.bucket = 'type' THEN p.t ELSE p.v END, a.target))", "arrays_after", "reported"),
        "status_problems": ask(COMPARED + DISAGREE, "decl", "verdict", "status"),
        "status_gate": ask(
            COMPARED + DISAGREE + " UNION ALL SELECT 'report', 'the header says ' || (n + 1) || ', listed are ' || n FROM (SELECT count(*) AS n FROM listed)"
            " UNION ALL SELECT id::VARCHAR, 'assumptions without a status' FROM x WHERE here AND status IS NULL AND id % 5 <> 0 UNION ALL SELECT id::VARCHAR, 'no assumptions' FROM x WHERE here AND status IS NOT NULL AND id % 5 = 0 UNION ALL SELECT id::VARCHAR, 'assumptions unsorted or repeated' FROM x WHERE here AND status IS NOT NULL AND id % 5 = 1"
            " UNION ALL SELECT id::VARCHAR, 'tainted without the placeholder among its assumptions' FROM x WHERE here AND (status = 'unverified' OR origin IS NOT NULL) AND id % 5 IN (1, 3, 4)",
            "decl",
            "verdict",
            "status",
        ),
        "assumption_problems": ask(
            "SELECT id AS name, 'assumptions without a status' AS problem FROM status WHERE status IS NULL AND id % 5 <> 0 UNION ALL SELECT id, 'no assumptions' FROM status WHERE status IS NOT NULL AND id % 5 = 0 UNION ALL SELECT id, 'assumptions unsorted or repeated' FROM status WHERE status IS NOT NULL AND id % 5 = 1"
            " UNION ALL SELECT id, 'tainted without the placeholder among its assumptions' FROM status WHERE (status = 'unverified' OR origin IS NOT NULL) AND id % 5 IN (1, 3, 4)",
            "status",
        ),
        "extract_command": ask(
            "SELECT 'probe:N' || d.id AS name, d.kind, CASE WHEN d.id IN (SELECT src FROM c_walk WHERE dst = -1) THEN 'unverified' WHEN d.id IN (SELECT id FROM c_taint) THEN 'verified' WHEN t.id IS NOT NULL THEN 'trusted' ELSE 'transitively-verified' END AS status,"
            " CASE WHEN d.id NOT IN (SELECT id FROM c_taint) THEN t.reason END AS reason, CASE WHEN d.id IN (SELECT id FROM c_taint) AND d.id NOT IN (SELECT src FROM c_walk WHERE dst = -1) THEN 'kernel-taint' END AS origin,"
            " (SELECT count(*) FROM c_deps e WHERE e.src = d.id AND role = 'type' AND NOT out) AS n_type, (SELECT count(*) FROM c_deps e WHERE e.src = d.id AND role = 'value' AND NOT out) AS n_term, (SELECT count(DISTINCT dst) FROM c_deps e WHERE e.src = d.id AND out) AS n_external, 'probe:N' || f.source AS primary_spec"
            " FROM decl d LEFT JOIN trusted t ON t.id = d.id LEFT JOIN c_first f ON f.target = d.id WHERE d.in_project AND NOT d.aux",
            "c_walk",
            "c_taint",
            "c_deps",
            "c_first",
            "trusted",
        ),
        "check_axioms_trusted": ask("SELECT 'N' || id AS name, reason, id IN (SELECT id FROM c_taint) AS is_statement_tainted FROM trusted", "c_taint", "trusted"),
        "document_entries": ask("SELECT 'probe:{\"' || id AS name, kind, '} \"' || kind || '\": {\\' AS text, lines_start FROM decl", "decl"),
        "check_axioms_command": ask("SELECT 'N' || id AS name, NOT (SELECT aux FROM decl d WHERE d.id = c_taint.id) AS is_emitted, id IN (SELECT src FROM c_walk WHERE dst = -1) AS is_direct FROM c_taint", "c_taint", "decl"),
        "viewify_command": ask("SELECT replace(module, '.', '/') || '.lean/probe:N' || id AS view_key, (id + 1) || '-' || (id + 2) AS code_lines FROM decl WHERE in_project AND NOT aux AND ends_with(module, '.Funs')", "decl"),
        "line_ranges": ask("SELECT id, CAST(CASE WHEN id % 3 = 2 AND id % 2 = 1 THEN 0 ELSE id END AS INT) AS lines_start, CAST(CASE id % 3 WHEN 0 THEN id + 5 WHEN 1 THEN id + 7 ELSE CASE WHEN id % 2 = 1 THEN 0 ELSE id END END AS INT) AS lines_end FROM decl", "decl"),
        "rust_source": ask("SELECT id, CASE id % 4 WHEN 0 THEN 'src/' || kind || '.rs' WHEN 1 THEN '/root/.cargo/registry/x.rs' END AS source, id % 4 = 0 AS is_relevant FROM decl", "decl"),
    }


def oracle_sql() -> dict[str, str]:
    out = questions()
    realised = "CAST(regexp_extract(name, '_([0-9]+)$', 1) AS INT) % 5 = 1"
    made = lambda c: f"CASE WHEN {realised} THEN {c} || '.eq_1' ELSE {c} END"
    notes = [
        f"SELECT CASE WHEN {realised} THEN 'realised in several modules' ELSE 'declared in several modules' END AS note, {made('name')} AS name FROM ({out['merged_decls']})",
        f"SELECT 'declared outside too', {made('name')} FROM ({out['cross_boundary']})",
        f"SELECT 'generated axioms', id::VARCHAR FROM ({out['generated_axioms']})",
        f"SELECT 'several primary specifications', target::VARCHAR FROM ({out['ambiguous_primary_specs']})",
        f"SELECT 'trusted roots', root FROM ({out['dependency_roots']})",
        f"SELECT 'repeated names', code_name FROM ({out['duplicate_names']})",
        f"SELECT 'colliding names', name FROM ({out['coimport_collisions']})",
    ]
    out["run_notes"] = (
        f"WITH found AS (SELECT DISTINCT note, name FROM ({' UNION ALL '.join(notes)})), placed AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY name) AS place FROM found)"
        " SELECT note, count(*) AS n, string_agg(name, ', ' ORDER BY name) FILTER (place <= 10) || CASE WHEN count(*) > 10 THEN ', … and ' || (count(*) - 10) || ' more' ELSE '' END AS names FROM placed GROUP BY note"
    )
    return out
