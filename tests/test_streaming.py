"""A streaming run over all files equals the batch result."""

from __future__ import annotations

import datetime as dt
import random

from quarrylight.streaming import monitor

SCHEMA = "event_id long, key long, ts timestamp, event_type string, value double"


def events(spark, n=200):
    rnd = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, rnd.randrange(4), t0 + dt.timedelta(minutes=rnd.randrange(3000)), rnd.choice("ab"), float(rnd.randrange(9))) for i in range(n)], SCHEMA)


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    where = str(tmp_path / "in")
    e.repartition(4).write.parquet(where)
    got = monitor.run_available(spark, where, e.schema, monitor.tumbling, watermark="10 minutes")
    assert rows(got) == rows(monitor.tumbling(e))


def test_no_files_give_an_empty_result(spark, tmp_path):
    (tmp_path / "none").mkdir()
    got = monitor.run_available(spark, str(tmp_path / "none"), events(spark, 1).schema, monitor.tumbling)
    assert got.count() == 0 and got.columns == ["start", "event_type", "events", "total"]


def test_sessions_and_late_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0, 1), (1, t0 + dt.timedelta(minutes=29), 2), (1, t0 + dt.timedelta(minutes=90), 3), (1, t0, 4)], "key long, ts timestamp, seq int")
    assert [(x.start, x.events) for x in monitor.sessions(df.where("seq < 4")).orderBy("start").collect()] == [(t0, 2), (t0 + dt.timedelta(minutes=90), 1)]
    assert [x.seq for x in monitor.late_rows(df).collect()] == [4]


def test_upsert_and_significance(spark):
    s = "key int, at int, score double"
    old = spark.createDataFrame([(1, 1, 9.0), (2, 5, 1.0)], s)
    new = spark.createDataFrame([(1, 2, 3.0), (2, 4, 7.0), (3, 1, 1.0)], s)
    assert rows(monitor.upsert_latest(old, new, ["key"], "at")) == [(1, 2, 3.0), (2, 5, 1.0), (3, 1, 1.0)]
    assert [(x.at, x.significant) for x in monitor.significant(spark.createDataFrame([(1, 1, 9.0), (1, 2, 3.0), (1, 3, 2.0)], s)).orderBy("at").collect()] == [(1, False), (2, True), (3, False)]
