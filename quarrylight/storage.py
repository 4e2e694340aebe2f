"""Reading tables and cutting lineage on shared storage.

Long plans and loops are cut by writing a table into the folder that
``spark.checkpoint.dir`` names, so that a lost executor costs a re-read and not
a recomputation. A folder of our own is only made where that setting is empty,
as in tests on one machine.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast explicitly. The bytes are
#: those of the files that are read (compressed about fourfold here).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8_000_000

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folder:
        _own_folder[key] = tempfile.mkdtemp(prefix="quarrylight-")
    return _own_folder[key]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The result has exact size statistics, prunes columns and survives the loss
    of executors. Drop it with :func:`release` when a later step replaced it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    # nullable on reading: parquet does not keep NOT NULL
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    out = spark.read.schema(schema).parquet(path)
    out._quarrylight_path = path
    out._quarrylight_rows = seen.get["rows"]  # counted while writing, no further job
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows, known already for a table made by :func:`materialize`."""
    known = getattr(df, "_quarrylight_rows", None)
    return df.count() if known is None else known


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize`; anything else is left alone."""
    path = getattr(df, "_quarrylight_path", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    df._quarrylight_path = None


def free_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files go that no plan needs any more: Spark deletes them when the driver collects its garbage, which may else take half an hour."""
    gc.collect()  # plans are held from Python
    spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only where the counted rows and the bytes behind them are within the bounds.

    The rows of a table made by :func:`materialize` are known, as are the bytes
    of its files; a frame whose bytes the optimizer cannot tell is left to it.
    """
    rows = rows_of(df) if rows is None else rows
    if rows > BROADCAST_ROWS or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def latest_rows(df: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Of the rows of one key, the one with the greatest ``stamp``.

    Re-deliveries repeat a key; the latest one counts. Equal stamps are settled
    by the remaining columns in schema order, greatest first (maps by their
    JSON), so the result is one definite row. Rows with a null stamp come last;
    null keys form a key of their own. An aggregate: it combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in key and c != stamp]
    order = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in rest]
    best = F.max_by(F.struct(stamp, *rest), F.struct(F.col(stamp), *order)).alias("_best")
    return df.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in df.columns])


def null_safe_hash(*columns: str) -> "F.Column":
    """64-bit hash that also tells a null from a missing neighbour."""
    parts = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrylight-code-")
    target = os.path.join(folder, "quarrylight_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(target)
    _shipped.add(context.applicationId)
