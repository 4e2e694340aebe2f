"""Points made from few bytes are many rows; no join of them may send them to the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import resolve


def test_points_and_scopes_are_not_broadcast(spark):
    files = spark.range(50).selectExpr("'r' as g", "concat('f', id) as path", "id as k")
    points = files.select("g", "path", F.explode(F.array(F.lit(5), F.lit(12), F.lit(300))).alias("at"), F.col("k").alias("i")).selectExpr("g", "path", "at", "i * 1000 + at as id")
    outer = files.selectExpr("g", "path", "10 as start", "400 as end", "'outer' as scope")
    scopes = outer.unionByName(files.selectExpr("g", "path", "11 as start", "13 as end", "'inner' as scope"))
    found = resolve.enclosing_scopes(points, scopes)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.at, r.scope) for r in found.collect()} == {(5, None), (12, "inner"), (300, "outer")} and found.count() == 150
