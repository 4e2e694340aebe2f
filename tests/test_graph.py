"""Graph operators against plain searches over small random graphs."""

from __future__ import annotations

import random
from collections import deque

import pytest

from quarrylight.operators import graph

EDGE = "g string, src string, dst string"


def random_edges(seed, n=18, m=34):
    rnd = random.Random(seed)
    return sorted({("g%d" % g, f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for g in range(2) for _ in range(m)})


def bfs(edges, g, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for gg, a, b in edges:
            if gg == g and a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


@pytest.mark.parametrize(("seed", "local"), [(3, True), (4, False)])
def test_reach_and_its_mirror(spark, seed, local):
    edges = random_edges(seed)
    e = spark.createDataFrame(edges, EDGE)
    starts = spark.createDataFrame([("g0", "n00"), ("g1", "n05")], "g string, start string")
    got = {(x.g, x.node): x.depth for x in graph.reach(e, starts, local=local).collect()}
    assert got == {(g, n): d for g, s in (("g0", "n00"), ("g1", "n05")) for n, d in bfs(edges, g, s).items()}
    back = {(x.g, x.node): x.depth for x in graph.reach(graph.reverse(graph.reverse(e)), starts, local=local).collect()}
    assert back == got


@pytest.mark.parametrize(("seed", "local"), [(3, False), (8, True)])
def test_components(spark, seed, local):
    edges = random_edges(seed)
    e = spark.createDataFrame(edges, EDGE)
    names = {(g, x) for g, a, b in edges for x in (a, b)}
    reach = {(g, n): set(bfs(edges, g, n)) for g, n in names}
    strong = {(g, n): min(m for m in reach[(g, n)] if n in reach[(g, m)]) for g, n in names}
    size = {}
    for (g, _), c in strong.items():
        size[(g, c)] = size.get((g, c), 0) + 1
    assert {(x.g, x.node): x.component for x in graph.strong_components(e, local).collect()} == {k: c for k, c in strong.items() if size[(k[0], c)] > 1}
    both = [*edges, *((g, b, a) for g, a, b in edges)]
    assert {(x.g, x.node): x.component for x in graph.weak_components(e).collect()} == {(g, n): min(bfs(both, g, n)) for g, n in names}


def test_chain_from_the_worked_example(spark):
    names = ["backend/main.py", "services/api.py", "services/auth.py", "services/user_service.py", "utils/helpers.py"]
    e = spark.createDataFrame([("g", a, b) for a, b in zip(names, names[1:])], EDGE)
    start = spark.createDataFrame([("g", "services/auth.py")], "g string, start string")
    up = {(x.node, x.depth) for x in graph.reach(graph.reverse(e), start).where("depth > 0").collect()}
    assert up == {("services/api.py", 1), ("backend/main.py", 2)}
    assert {x.node: x.centrality for x in graph.centrality(e).collect()} == {n: 0.25 if n in (names[0], names[-1]) else 0.5 for n in names}
    assert graph.statistics(e).first().density == 0.2
    assert {x.node: x.level for x in graph.levels(e).collect()} == {n: i for i, n in enumerate(names)}


def test_empty_graph(spark):
    e = spark.createDataFrame([], EDGE)
    s = spark.createDataFrame([], "g string, start string")
    for df in (graph.reach(e, s), graph.weak_components(e), graph.strong_components(e), graph.levels(e), graph.statistics(e), graph.neighbours(e, s)):
        assert df.count() == 0


def test_dead_code_and_cycles(spark):
    e = spark.createDataFrame([("g", "main", "a"), ("g", "a", "b"), ("g", "x", "y"), ("g", "y", "x"), ("g", "y", "z"), ("g", "z", "z")], EDGE)
    entry = spark.createDataFrame([("g", "main")], "g string, node string")
    assert {(x.node, x.status) for x in graph.dead_code(e, entry).collect()} == {("x", "orphan"), ("y", "orphan"), ("z", "orphan")}
    assert [tuple(x) for x in graph.cycle_summary(e).collect()] == [("g", 1, 2, 1)]
    assert {tuple(x.cycle) for x in graph.short_cycles(e).collect()} == {("z",), ("x", "y")}
