"""Churn, ownership and trends of a change history.

touches: rows (hash, author, ts, path, status), one for each file a commit
touched. Statuses are added, modified, deleted, renamed, copied or other words.
Ties are settled by key, never by row order. Null paths and times are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_git_log(lines: DataFrame, mark: str = "COMMIT") -> DataFrame:
    """Touches from a captured log.

    lines: (log, line_no, line); a header line is ``mark|hash|author|iso time``, the
    lines under it are status and path apart by tabs, and a rename or copy (R100,
    C75) names old and new path, of which the new one counts. The running header
    is a window over line_no, one log a partition.
    """
    w = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith(f"{mark}|"), F.split("line", r"\|"))
    rows = lines.withColumn("h", F.last(head, ignorenulls=True).over(w)).where(f"line not like '{mark}|%' and trim(line) <> '' and h is not null")
    part = F.split("line", "\t")
    code = F.substring(part[0], 1, 1)
    status = (
        F.when(code == "M", "modified").when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").when(code == "C", "copied").when(code == "T", "modified").otherwise("modified")
    )
    path = F.when(code.isin("R", "C"), F.try_element_at(part, F.lit(3))).otherwise(F.try_element_at(part, F.lit(2)))
    return rows.select(F.col("h")[1].alias("hash"), F.col("h")[2].alias("author"), F.to_timestamp(F.col("h")[3]).alias("ts"), path.alias("path"), status.alias("status")).where("path is not null")


def churn(touches: DataFrame, compat: bool = False) -> DataFrame:
    """(path, commits, last_ts, is_deleted, score, primary_author, authors, bus_factor_risk).

    score = 100 * commits / the most of any path, two digits. is_deleted is the
    status at the latest touch; with ``compat``, at the earliest. The primary
    author has the most touches, ties to the lesser name; more than 80 % of all
    touches by one author is a risk.
    """
    touches = touches.where("path is not null and ts is not null")
    by_author = touches.groupBy("path", "author").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), (F.min(F.struct("ts", "hash", "status")) if compat else F.max(F.struct("ts", "hash", "status"))).alias("s")
    )
    ends = F.min("s") if compat else F.max("s")
    per_path = by_author.groupBy("path").agg(
        F.sum("n").alias("commits"),
        F.max("last_ts").alias("last_ts"),
        ends["status"].alias("status"),
        F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("primary_author"),
        F.count(F.lit(1)).alias("authors"),
        F.max("n").alias("top"),
    )
    most = per_path.agg(F.max("commits")).scalar()  # a scalar subquery
    return per_path.select(
        "path",
        "commits",
        "last_ts",
        (F.col("status") == "deleted").alias("is_deleted"),
        F.round(100.0 * F.col("commits") / most, 2).alias("score"),
        "primary_author",
        "authors",
        (F.col("top") / F.col("commits") > 0.8).alias("bus_factor_risk"),
    )


def ownership(touches: DataFrame, top: int = 50) -> DataFrame:
    """(path, commits, share, owner, histogram) of the paths with the most commits, share in per cent, one digit."""
    n = touches.where("path is not null").groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy("path").agg(
        F.sum("n").alias("commits"), F.max("n").alias("most"), F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("owner"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "n")))).alias("histogram")
    )
    out = out.select("path", "commits", F.round(100.0 * F.col("most") / F.col("commits"), 1).alias("share"), "owner", "histogram")
    return out.orderBy(F.desc("commits"), "path").limit(top)


def weekly(touches: DataFrame) -> DataFrame:
    """(week, commits, files, authors) by the Monday of each week."""
    out = touches.where("ts is not null").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"))
    return out.agg(F.countDistinct("hash").alias("commits"), F.countDistinct("path").alias("files"), F.array_join(F.array_sort(F.collect_set(F.col("author").cast("string"))), ",").alias("authors"))


def hotspots(churned: DataFrame, central: DataFrame, top: int = 20) -> DataFrame:
    """(path, score, centrality, hotspot): churn * (1 + centrality), four digits.

    central: (path, centrality). Without an exact match (or with 0) the nonzero
    centrality of the least path of the same file name is taken.
    """
    name = F.element_at(F.split("path", "/"), -1)
    exact = central.select("path", F.col("centrality").alias("c1"))
    base = central.where("centrality <> 0").groupBy(name.alias("name")).agg(F.min_by("centrality", "path").alias("c2"))
    out = churned.join(exact, "path", "left").withColumn("name", name).join(base, "name", "left")
    c = F.coalesce(F.expr("nullif(c1, 0)"), "c2", F.lit(0.0))
    out = out.select("path", "score", F.round(c, 4).alias("centrality"), F.round(F.col("score") * (1 + c), 4).alias("hotspot"))
    return out.orderBy(F.desc("hotspot"), "path").limit(top)


def trend(points: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """(series, points, slope, direction, velocity, volatility, confidence).

    points: (series, at, value). slope is that of the end points, volatility the
    population deviation of consecutive differences, confidence = 1 - volatility /
    the greatest value, times 0.7 under three points.
    """
    w = Window.partitionBy("series").orderBy("at", "value")
    lagged = points.dropna(subset=["series", "at", "value"]).withColumn("diff", F.col("value") - F.lag("value").over(w))
    out = lagged.groupBy("series").agg(
        F.count(F.lit(1)).alias("points"),
        ((F.max_by("value", F.struct("at", "value")) - F.min_by("value", F.struct("at", "value"))) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("slope"),
        F.coalesce(F.stddev_pop("diff"), F.lit(0.0)).alias("volatility"),
        F.max(F.abs("value")).alias("top"),
    )
    good = 1.0 if higher_is_better else -1.0
    direction = F.when(F.col("slope") * good > 1e-4, "improving").when(F.col("slope") * good < -1e-4, "degrading").otherwise("stable")
    confidence = F.greatest(F.lit(0.0), 1 - F.when(F.col("top") > 0, F.col("volatility") / F.col("top")).otherwise(0.0)) * F.when(F.col("points") < 3, 0.7).otherwise(1.0)
    return out.select("series", "points", "slope", direction.alias("direction"), F.when(F.abs("slope") >= 1.0, "fast").when(F.abs("slope") >= 0.1, "moderate").otherwise("slow").alias("velocity"), "volatility", confidence.alias("confidence"))


def last_n_as_of(snapshots: DataFrame, events: DataFrame, n: int = 5) -> DataFrame:
    """Per key, the events since the oldest of the newest n snapshots.

    snapshots: (key, at); events: (key, at, ...).
    """
    w = Window.partitionBy("key").orderBy(F.desc("at"))
    since = snapshots.withColumn("r", F.row_number().over(w)).where(f"r <= {n}").groupBy("key").agg(F.min("at").alias("since"))
    return events.join(since, "key").where("at >= since").drop("since")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """For each (key, at) of the left the latest value of the right at or before it.

    One union and one window instead of a range join; the key's partition is sorted once.
    """
    both = left.select("key", "at", F.lit(None).cast(dict(right.dtypes)[value]).alias("v"), F.lit(1).alias("side")).unionByName(right.select("key", "at", F.col(value).alias("v"), F.lit(0).alias("side")))
    w = Window.partitionBy("key").orderBy("at", "side", F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("key", "at", F.col("v").alias(value))
