"""Searches from every node without a list of starts: the rows of the frontier loop, whatever the pairs that a task looks after at a time."""

from __future__ import annotations

import random

import pytest

from quarrylight import api
from quarrylight.operators import graph


@pytest.fixture(params=[4_000_000, 40])
def edges(spark, request, monkeypatch):
    """Random graphs, a cycle with a tail and a self loop; few pairs at a time part searches and levels."""
    monkeypatch.setattr(graph, "LOCAL_CELLS", request.param)
    monkeypatch.setattr(graph, "LOCAL_WORK", 400)
    rnd = random.Random(5)
    found = {(f"g{g}", f"n{rnd.randrange(25):02d}", f"n{rnd.randrange(25):02d}") for g in range(2) for _ in range(45)}
    found |= {("g2", f"c{i}", f"c{(i + 1) % 7}") for i in range(7)} | {("g2", "c3", "t"), ("g2", "t", "u"), ("g3", "a", "a")}
    return spark.createDataFrame(sorted(found), "g string, src string, dst string")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def by_levels(edges, **how):
    return graph.reach(edges, graph.nodes(edges).withColumnRenamed("node", "start"), local=False, **how)


def test_impact_of_every_node(edges):
    """q07_impact"""
    assert rows(api.graph_question("impact", edges)) == rows(by_levels(graph.reverse(edges)).where("depth > 0"))


def test_paths_toward_one_end(spark, edges):
    """q07_paths searches with the same arrays, against the edges."""
    ends = spark.createDataFrame([("g0", "n03"), ("g1", "n07"), ("g2", "u"), ("g2", "c0")], "g string, start string")
    got, levels = (rows(graph.reach(graph.reverse(edges), ends, paths=True, toward=True, local=x)) for x in (True, False))
    assert got == levels


def test_levels_from_every_node(edges):
    """g01_bfs, within a bound of depth as well."""
    assert rows(graph.reach(edges, None)) == rows(by_levels(edges))
    assert rows(graph.reach(edges, None, 2)) == rows(by_levels(edges, max_depth=2))


def test_counts_leave_the_tasks(edges):
    """g04_closure"""
    want = by_levels(edges).groupBy("g", "start").count().selectExpr("g", "start", "count - 1 as reached")
    assert rows(graph.reach_counts(edges)) == rows(want) == rows(graph.reach_counts(edges, local=False))


def test_search_against_the_edges_from_every_node(edges):
    """g02_reverse_bfs, by the frontier loop as well."""
    back = graph.reverse(edges)
    assert rows(graph.reach(back, None)) == rows(graph.reach(back, None, local=False)) == rows(by_levels(back))


def test_paths_leave_the_tasks_as_texts(edges):
    """g05_shortest_paths, in batches of few path nodes as well."""
    want = rows(by_levels(edges, paths=True).selectExpr("g", "start", "node", "depth", "array_join(path, ' > ') as path"))
    assert rows(graph.reach(edges, None, paths=True, joined=" > ")) == want == rows(graph.reach(edges, None, paths=True, joined=" > ", local=False))
    assert rows(graph.reach(edges, None, paths=True).selectExpr("g", "start", "node", "depth", "array_join(path, ' > ') as path")) == want


def test_descendants_of_every_node(edges):
    """q07_descendants"""
    assert rows(api.graph_question("descendants", edges)) == rows(by_levels(edges).where("depth > 0"))
