"""Event streams: windows with watermarks, sessions, keyed state, triggers and upserts.

Batch and stream share one transformation each, so a run over all available data
equals the batch result. Streams read files as they arrive and write through
``foreachBatch`` into the shared folder, where their checkpoint lies as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.storage import shared_folder


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """(start, event_type, events, total) in windows that do not overlap."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """(start, events) in overlapping windows."""
    return events.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, events): runs of a key's events with less than ``gap`` between them; end is the last event."""
    return events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("end")).select("key", F.col("w.start").alias("start"), "end", "events")


def late_rows(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events whose time lies more than ``delay`` before the greatest time seen up to them in arrival order (column ``seq``)."""
    from pyspark.sql.window import Window

    seen = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("seen", F.max("ts").over(seen)).where(F.col("ts") < F.col("seen") - F.expr(f"interval {delay}"))


def run_available(spark: SparkSession, source: str, schema, build: Callable[[DataFrame], DataFrame], watermark: str | None = "10 minutes", mode: str = "complete") -> DataFrame:
    """Run a streaming query over all files of ``source`` now and return what it wrote.

    mode ``complete`` keeps the last full result, ``append`` and ``update`` every batch.
    Without any file the result is empty.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source)
    if watermark:
        stream = stream.withWatermark("ts", watermark)

    wrote: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        wrote.append(number)
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    result = build(stream)
    q = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out") if wrote else spark.createDataFrame([], result.schema)


TRIGGERS = "key long, ts timestamp, reason string"


def count_trigger(threshold: int = 5) -> Callable[[DataFrame], DataFrame]:
    """A keyed state that fires each time a key has seen ``threshold`` events since it fired last.

    Events count in time order within a micro-batch, and by arrival between micro-batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        fired = []
        # all rows of the key in this micro-batch, in order, however many Arrow batches bring them
        for ts in pd.concat([b["ts"] for b in batches]).sort_values():
            n += 1
            if n >= threshold:
                fired.append((key[0], ts, f"count>={threshold}"))
                n = 0
        state.update((n,))
        yield pd.DataFrame(fired, columns=["key", "ts", "reason"])

    return lambda stream: stream.groupBy("key").applyInPandasWithState(step, TRIGGERS, "n long", "append", GroupStateTimeout.NoTimeout)


def time_trigger(seconds: int = 3600) -> Callable[[DataFrame], DataFrame]:
    """A keyed state that fires at an event that comes ``seconds`` or more after it fired last, and at a key's first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        fired = []
        for ts in pd.concat([b["ts"] for b in batches]).sort_values():
            now = int(ts.value // 1000)
            if last is None or now - last >= seconds * 1_000_000:
                fired.append((key[0], ts, f"age>={seconds}"))
                last = now
        state.update((last,))
        yield pd.DataFrame(fired, columns=["key", "ts", "reason"])

    return lambda stream: stream.groupBy("key").applyInPandasWithState(step, TRIGGERS, "last long", "append", GroupStateTimeout.NoTimeout)


#: Trigger policies by name; at once fires at every event, on request at none by itself.
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "count": count_trigger(5),
    "time": time_trigger(3600),
    "immediate": lambda stream: stream.select("key", "ts", F.lit("immediate").alias("reason")),
    "manual": lambda stream: stream.where("false").select("key", "ts", F.lit("manual").alias("reason")),
}


def count_trigger_batch(events: DataFrame, threshold: int = 5) -> DataFrame:
    """The same over a table: every ``threshold``-th event of a key in time order."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("key").orderBy("ts"))
    return events.select("key", "ts", n.alias("n")).where(f"n % {threshold} = 0").select("key", "ts")


def significant(snapshots: DataFrame, drop: float = 5.0) -> DataFrame:
    """(key, at, change, significant): snapshots whose score fell by more than ``drop``."""
    from pyspark.sql.window import Window

    before = F.lag("score").over(Window.partitionBy("key").orderBy("at"))
    out = snapshots.withColumn("change", F.col("score") - before)
    return out.select("key", "at", "change", F.coalesce(F.col("change") < -drop, F.lit(False)).alias("significant"))


def upsert_latest(target: DataFrame, changes: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """A state table after a batch of changes; the latest row of each key stays."""
    both = target.unionByName(changes.select(target.columns))
    rest = [c for c in target.columns if c not in (*key, stamp)]
    return both.groupBy(*key).agg(F.max(F.struct(stamp, *rest)).alias("r")).select(*key, *[f"r.{c}" for c in [stamp, *rest]]).select(target.columns)


def incremental_plan(current: DataFrame, manifest: DataFrame, symbols: DataFrame) -> DataFrame:
    """(action, path, symbols): what to index anew or delete, with the symbols it affects."""
    from quarrylight.operators.diff import manifest_diff

    changed = manifest_diff(manifest, current, renames=False).where("change <> 'unchanged'")
    action = F.when(F.col("change") == "deleted", "delete").otherwise("reindex")
    n = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    return changed.select(action.alias("action"), "path").join(n, "path", "left").select("action", "path", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def build_plan(stages: dict[str, list[str]], changed: bool, has_manifest: bool, has_snapshot: bool, schema_matches: bool, forced: bool = False) -> dict[str, str]:
    """FULL, PARTIAL or SKIP for each stage of a dependency graph.

    stages: stage -> the stages it needs. A plan of a handful of names, made on the
    driver; a cycle is an error.
    """
    whole = forced or not has_manifest or not has_snapshot or not schema_matches
    out: dict[str, str] = {}
    left = dict(stages)
    while left:
        free = sorted(n for n, needs in left.items() if all(d in out for d in needs))
        if not free:
            raise ValueError(f"the stages {sorted(left)} need one another")
        for n in free:
            needs = left.pop(n)
            out[n] = "FULL" if whole else "PARTIAL" if (changed and not needs) or any(out[d] != "SKIP" for d in needs) else "SKIP"
    return out
