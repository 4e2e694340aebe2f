"""The result cache, the sink of seen rows and stateful triggers."""

from __future__ import annotations

import pytest

from quarrylight.cache import ResultCache
from quarrylight.operators import graph
from quarrylight.storage import BROADCAST_ROWS, broadcast_if_small, latest_rows, materialize, shared_folder


def test_results_are_kept_expire_and_leave(spark):
    now, built = [0.0], []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    cache = ResultCache(entries=2, seconds=10, clock=lambda: now[0])
    assert cache.get(("a", 1), build(3)).count() == 3 and cache.get(("a", 1), build(4)).count() == 3 and built == [3]
    cache.get(("b", 1), build(5))
    cache.get(("a", 1), build(6))
    cache.get(("c", 1), build(7))  # the least recently used, b, leaves
    assert cache.get(("b", 1), build(8)).count() == 8 and built == [3, 5, 7, 8]
    now[0] = 11.0
    assert cache.get(("b", 1), build(9)).count() == 9
    assert cache.invalidate("b") == 1 and cache.get(("b", 1), build(2)).count() == 2 and cache.invalidate() == 2 and not cache.kept


def test_seen_rows_stay_in_few_tables(spark):
    seen = graph.Seen(["k"])
    for i in range(40):
        seen.add(materialize(seen.new(spark.range(i, i + 3).withColumnRenamed("id", "k")), "t"))
    assert len(seen.parts) <= 9 and sorted(r.k for r in seen.all().collect()) == list(range(42))


def test_long_graphs_by_frontier_equal_those_in_tasks(spark):
    edges = spark.createDataFrame([("g", f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("g", "n20", "n05"), ("g", "n03", "n09")], "g string, src string, dst string")
    starts = spark.createDataFrame([("g", "n00"), ("g", "n07")], "g string, start string")
    for paths in (False, True):
        a, b = (sorted(map(tuple, graph.reach(edges, starts, paths=paths, local=x).select("start", "node", "depth", *(["path"] if paths else [])).collect())) for x in (True, False))
        assert a == b and len(a) == 21 + 16


def test_broadcasts_are_bounded(spark):
    small, large = spark.range(10), spark.range(10)
    assert "BroadcastExchange" in spark.range(5).join(broadcast_if_small(materialize(small, "s")), "id")._jdf.queryExecution().executedPlan().toString()
    assert broadcast_if_small(large, BROADCAST_ROWS + 1) is large


def test_latest_rows_settle_ties_and_nulls(spark):
    rows = [("a", 1, "x", {"k": 1}), ("a", 2, "b", {"k": 1}), ("a", 2, "c", {"k": 2}), ("b", None, "n", None), ("b", 1, None, None), (None, 1, "z", None), (None, 1, "z", None)]
    df = spark.createDataFrame(rows, "k string, at int, v string, m map<string,int>")
    assert {(r.k, r.at, r.v) for r in latest_rows(df, ["k"], "at").collect()} == {("a", 2, "c"), ("b", 1, None), (None, 1, "z")}
    assert latest_rows(df.where("false"), ["k"], "at").count() == 0 and latest_rows(df, ["k"], "at").columns == df.columns


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: other)

    with pytest.raises(ValueError):
        shared_folder(Session)
