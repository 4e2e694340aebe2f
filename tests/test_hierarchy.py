"""Problem 1: trees, cycles and the cases of dirty links."""

from __future__ import annotations

import random

import pytest

from quarrylight.operators.hierarchy import Hierarchy, further_parents, parent_links

LINK = "repository_id string, commit_sha string, node_id string, parent_id string"


def expected(links):
    """(paths of nodes with a root, cycle heads) by walking up."""
    up = {(r, c, n): p for r, c, n, p in links}
    rooted, cyclic = {}, {}
    nodes = set(up) | {(r, c, p) for r, c, _, p in links}
    for r, c, n in nodes:
        way = [n]
        while (r, c, way[-1]) in up and up[(r, c, way[-1])] not in way:
            way.append(up[(r, c, way[-1])])
        if (r, c, way[-1]) in up:
            ring = way[way.index(up[(r, c, way[-1])]) :]
            cyclic[(r, c, n)] = min(ring)
        else:
            rooted[(r, c, n)] = way[::-1]
    return rooted, cyclic


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_match_walking_up(spark, seed):
    rnd = random.Random(seed)
    links = []
    for g in range(3):
        n = 120
        for i in range(1, n):
            if rnd.random() < 0.9:
                p = rnd.randrange(i) if rnd.random() < 0.8 else i - 1
                links.append(("r", f"c{g}", f"n{i}", f"n{p}"))
        links += [("r", f"c{g}", f"x{i}", f"x{(i + 1) % 4}") for i in range(4)] + [("r", f"c{g}", "y", "x2"), ("r", f"c{g}", "z", "y"), ("r", f"c{g}", "s", "s")]
    rooted, cyclic = expected(links)
    h = Hierarchy(spark.createDataFrame(links, LINK))
    got = {(x.repository_id, x.commit_sha, x.node_id): list(x.path) for x in h.nodes().collect()}
    assert got == rooted
    assert all(len(x.path) == x.depth + 1 and x.path[0] == x.root_id for x in h.nodes().collect())
    assert {(x.repository_id, x.commit_sha, x.node_id): x.cycle_head for x in h.cyclic().collect()} == cyclic
    pairs = {(x.commit_sha, x.node_id, x.descendant_id, x.distance) for x in h.ancestor_pairs().collect()}
    assert pairs == {(c, a, n, len(w) - 1 - i) for (r, c, n), w in rooted.items() for i, a in enumerate(w[:-1])}


def test_deep_chain_takes_few_jobs_and_is_whole(spark):
    links = [("r", "c", f"n{i:04d}", f"n{i - 1:04d}") for i in range(1, 300)] + [("r", "c", f"leaf{i}", "n0000") for i in range(400)]
    h = Hierarchy(spark.createDataFrame(links, LINK))
    assert {(x.node_id, x.depth) for x in h.nodes().collect()} == {(f"n{i:04d}", i) for i in range(300)} | {(f"leaf{i}", 1) for i in range(400)}
    assert h.cyclic().count() == 0


def test_nulls_repeats_empty_and_further_columns(spark):
    rows = [("r", "c", "a", "root", 1), ("r", "c", "a", "root", 1), ("r", "c", None, "root", 2), ("r", None, "b", "root", 3)]
    df = spark.createDataFrame(rows, LINK + ", path int")
    assert {(x.node_id, x.depth) for x in Hierarchy(df).nodes().collect()} == {("root", 0), ("a", 1)}
    empty = Hierarchy(spark.createDataFrame([], LINK))
    assert empty.nodes().count() == 0 and empty.cyclic().count() == 0 and empty.ancestor_pairs().count() == 0


def test_without_paths_cycles_are_the_same(spark):
    links = [("r", "c", "a", "b"), ("r", "c", "b", "a"), ("r", "c", "d", "a"), ("r", "c", "k", "root")]
    h = Hierarchy(spark.createDataFrame(links, LINK), paths=False)
    assert {(x.node_id, x.cycle_head) for x in h.cyclic().collect()} == {("a", "a"), ("b", "a"), ("d", "a")}
    with pytest.raises(ValueError):
        h.nodes()


def test_parent_links_by_kind(spark):
    e = [("r", "c", " Contains ", "p", "k"), ("r", "c", "BELONGS_TO", "k", "p"), ("r", "c", "calls", "x", "y"), ("r", "c", "owns", None, "y"), ("r", "c", "declares", "q", "k"), ("r", "c", None, "a", "b")]
    df = spark.createDataFrame(e, "repository_id string, commit_sha string, kind string, source_id string, target_id string")
    assert [(x.node_id, x.parent_id) for x in parent_links(df).collect()] == [("k", "p")]


@pytest.mark.parametrize("thin", [0.0, 1.0])
def test_level_wise_and_jumping_ways_agree(spark, thin):
    """The share that ends the level-wise part changes the jobs, not the rows."""
    rnd = random.Random(7)
    links = [("r", "c", f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60)] + [("r", "c", f"m{i}", f"m{i - 1}") for i in range(1, 25)] + [("r", "c", "x", "y"), ("r", "c", "y", "x"), ("r", "c", "z", "y")]
    rooted, cyclic = expected(links)
    h = Hierarchy(spark.createDataFrame(links, LINK), thin=thin)
    assert {(x.repository_id, x.commit_sha, x.node_id): list(x.path) for x in h.nodes().collect()} == rooted
    assert {(x.repository_id, x.commit_sha, x.node_id): x.cycle_head for x in h.cyclic().collect()} == cyclic


def test_further_parents_are_reported(spark):
    e = [("r", "c", "contains", "p", "k"), ("r", "c", "belongs_to", "k", "p"), ("r", "c", "declares", "q", "k"), ("r", "c", "owns", "p", "a"), ("r", None, "owns", "p", "b"), ("r", "c", "calls", "z", "a")]
    df = spark.createDataFrame(e, "repository_id string, commit_sha string, kind string, source_id string, target_id string")
    assert {tuple(x) for x in further_parents(df).collect()} == {("r", "c", "k", "p", True), ("r", "c", "k", "q", False)}
