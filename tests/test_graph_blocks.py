"""Searches from every node: small graphs stay inside tasks, whatever edges times starts come to."""

from __future__ import annotations

import random

import pytest

from quarrylight import api
from quarrylight.operators import graph

EDGE = "g string, src string, dst string"


@pytest.fixture
def edges(spark):
    rnd = random.Random(11)
    rows = sorted({(f"g{g}", f"n{rnd.randrange(20):02d}", f"n{rnd.randrange(20):02d}") for g in range(2) for _ in range(30)})
    return spark.createDataFrame([*rows, ("g2", "a", "a"), ("g2", "a", "b")], EDGE)


@pytest.fixture
def levels(monkeypatch):
    """The written levels of frontier loops, with a bound of work that every graph exceeds."""
    labels = []
    was = graph.materialize
    monkeypatch.setattr(graph, "LOCAL_WORK", 100)
    monkeypatch.setattr(graph, "materialize", lambda df, label="step": labels.append(label) or was(df, label))
    return lambda: [x for x in labels if x in ("front", "near")]


def every(edges):
    return graph.nodes(edges).withColumnRenamed("node", "start")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def test_module_blast_from_every_node(edges, levels):
    """g14_module_blast: totals by plain closure, a start on a cycle counted, no frontier loop."""
    got = {(r.g, r.start): r.total for r in graph.module_blast(edges, every(edges)).collect()}
    assert not levels()
    e = {tuple(r) for r in edges.collect()}
    for g, start in got:
        hit, todo = set(), [start]
        while todo:
            at = todo.pop()
            new = {a for gg, a, b in e if gg == g and b == at} - hit
            hit |= new
            todo += new
        assert got[(g, start)] == len(hit)
    assert got[("g2", "a")] == 1 and got[("g2", "b")] == 1


@pytest.mark.parametrize("kind", ["impact", "descendants"])
def test_questions_from_every_node(edges, levels, kind):
    """q07_impact, q07_descendants: as the frontier loop has it, but in tasks."""
    got = rows(api.graph_question(kind, edges, starts=every(edges)))
    assert not levels()
    assert got == rows(graph.reach(edges if kind == "descendants" else graph.reverse(edges), every(edges), local=False).where("depth > 0"))


def test_search_from_every_node(edges, levels):
    """g01_bfs: blocks of starts give the rows of the frontier loop."""
    got = rows(graph.reach(edges, every(edges)))
    assert not levels() and got == rows(graph.reach(edges, every(edges), local=False))


def test_counts_from_every_node(edges, levels):
    """g04_closure: the counts of the frontier loop, within a bound of depth as well."""
    count = lambda df: rows(df.groupBy("g", "start").count())
    got, near = count(graph.reach(edges, every(edges))), count(graph.reach(edges, every(edges), 2))
    assert not levels()
    assert got == count(graph.reach(edges, every(edges), local=False)) and near == count(graph.reach(edges, every(edges), 2, local=False))


def test_paths_to_one_end(spark, edges, levels):
    """q07_paths: searched from the end, the rows of searches from every start."""
    target = spark.createDataFrame([("g0", "n03"), ("g1", "n07"), ("g2", "b")], "g string, target string")
    got = rows(api.graph_question("shortest_path", edges, starts=every(edges), targets=target))
    assert not levels()
    whole = graph.reach(edges, every(edges), paths=True, local=False)
    assert got == rows(whole.join(target.withColumnRenamed("target", "node"), ["g", "node"]))
    far = graph.reach(graph.reverse(edges), target.withColumnRenamed("target", "start"), paths=True, toward=True, local=False)
    assert got == rows(far.selectExpr("g", "node as start", "start as node", "depth", "path"))


def test_search_against_the_edges(edges, levels):
    """g02_reverse_bfs: blocks of starts give the rows of the frontier loop."""
    got = rows(graph.reach(graph.reverse(edges), every(edges)))
    assert not levels() and got == rows(graph.reach(graph.reverse(edges), every(edges), local=False))


def test_shortest_paths_from_every_node(edges, levels):
    """g05_shortest_paths: the smallest shortest paths of the frontier loop."""
    got = rows(graph.reach(edges, every(edges), paths=True))
    assert not levels() and got == rows(graph.reach(edges, every(edges), paths=True, local=False))
