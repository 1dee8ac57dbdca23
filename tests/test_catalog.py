"""Queries against the same questions in SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from lemmaflow.operators import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
NAMES = "document_entries check_axioms_trusted extract_command check_axioms_command viewify_command fold_classes primary_spec_rules ambiguous_primary_specs attribute_scan tag_audit head_lines fold_stats fixpoint_bodies companion_heads merged_location closure_problems loaded_differences missing_builds dependency_roots generated_axioms example_module already_contained shape_histogram proof_carriers hidden_by_position compare_artifacts added_dependencies status_problems status_gate run_notes assumption_problems rule3_candidates assumption_report assumption_category_counts artifact_diff status_counts unhide_contaminated import_closure decl_kind internal_name_filter emitted_decls trusted_base merged_trust walk_edges dependency_union external_split verification_status assumption_sets fold_recovered_edges merged_decls duplicate_versions coimport_collisions specs primary_spec derived_instance_clusters companion_theorems narrow_closure ownership owners_exact_cover view_molecules missing_dependencies graph_check line_ranges rust_source".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    asked = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in asked.description]
    assert sorted(order) == columns
    expected = sorted((tuple(r[order.index(c)] for c in columns) for r in asked.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["status_consistency", "artifact_diff"])
def test_one_walk_serves_both_reports(spark, monkeypatch, name):
    walks, walk = [], catalog.T.tainted
    monkeypatch.setattr(catalog.T, "tainted", lambda *a: walks.append(a) or walk(*a))
    assert catalog.queries()[name](spark, FOLDER).count() > 0
    assert len(walks) == 1


def broadcasts(spark, after=-1):
    """(last execution, broadcasts in the plans that ran after execution ``after``), of all sessions."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    ran = [x for x in (store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())) if x > after]
    nodes = [store.planGraph(x).allNodes() for x in ran]
    return max(ran, default=after), sum(n.apply(k).name().startswith("BroadcastExchange") for n in nodes for k in range(n.size()))


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["compare_artifacts", "status_problems", "unhide_contaminated", "verification_status", "status_counts", "status_skip_enrich", "status_skip_verify"])
def test_a_status_query_broadcasts_nothing(spark, monkeypatch, tmp_path, name):
    """No plan of a whole run has a broadcast, though all sides are small. The edges are given: Spark may broadcast lines to derive them while they are few."""
    catalog.Graph(spark, FOLDER).edge.write.parquet(str(tmp_path / "edge"))
    monkeypatch.setattr(catalog.Graph, "edge", property(lambda g: spark.read.parquet(str(tmp_path / "edge"))))
    start, _ = broadcasts(spark)
    assert catalog.queries()[name](spark, FOLDER).collect()
    assert broadcasts(spark, start)[1] == 0


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["edge", "imports"])
def test_lines_meet_lines_without_a_broadcast(spark, name):
    start, _ = broadcasts(spark)
    assert getattr(catalog.Graph(spark, FOLDER), name).collect()
    assert broadcasts(spark, start)[1] == 0


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["compare_artifacts", "status_problems", "unhide_contaminated", "verification_status", "status_counts", "status_skip_enrich", "status_skip_verify"])
def test_a_status_query_with_its_own_edges_broadcasts_nothing(spark, name):
    start, _ = broadcasts(spark)
    assert catalog.queries()[name](spark, FOLDER).collect()
    assert broadcasts(spark, start)[1] == 0
