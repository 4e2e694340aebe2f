"""Problem 1: the descendants themselves, on cycles and below them too."""

from __future__ import annotations

from quarrylight.plans import QUERIES


def test_every_node_names_its_descendants(spark, tmp_path):
    links = [("r", "a"), ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("s", "s"), ("s", "t")]
    rows = [("repo", "sha", f"e{i}", "contains", p, n, 1) for i, (p, n) in enumerate(links)]
    spark.createDataFrame(rows, "repository_id string, commit_sha string, edge_id string, kind string, source_id string, target_id string, delivered_at int").write.parquet(f"{tmp_path}/ria_graph_edge.parquet")
    got = {(r.node_id, r.descendant_id, r.distance) for r in QUERIES["p1_descendant_list"](spark, str(tmp_path)).collect()}
    assert got == {
        *(("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("a", "b", 1), ("a", "c", 2), ("b", "c", 1)),
        *(("x", "y", 1), ("y", "x", 1), ("y", "z", 1), ("x", "z", 2), ("z", "w", 1), ("y", "w", 2), ("x", "w", 3), ("s", "t", 1)),
    }
    counted = {(r.node_id, r.descendants, r.height) for r in QUERIES["p1_descendants"](spark, str(tmp_path)).collect()}
    assert counted == {("r", 3, 3), ("a", 2, 2), ("b", 1, 1)}
