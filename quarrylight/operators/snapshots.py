"""What changed between full snapshots.

Every commit may deliver a full snapshot of a table. Snapshots form a forest:
the one before a commit's is that of its nearest ancestor, along first parents,
that delivered rows. The forest is cut into chains, each record of a chain gets
validity intervals by gaps and islands over (key, row hash), and the starts,
ends and adjacencies of the intervals are the change events.

Commit metadata is walked by pointer doubling (rounds grow with the logarithm
of the history), never collected. The records are shuffled once, on chain and
record key together, so one repository with a third of all rows still spreads
over all tasks; all windows share that one partitioning and sort order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.storage import broadcast_if_small, materialize, null_safe_hash, release

#: Doubling rounds: enough for histories of 2**40 commits; only a cycle of
#: parents, which a history cannot have, gets so far.
MAX_ROUNDS = 40


@dataclass(frozen=True)
class SnapshotTable:
    """One table of full snapshots and how to read it.

    record_kind: label of its records in the result.
    rows: the table; repository, commit, key and stamp name its columns.
    compared: the columns whose change makes a record ``changed``.
    """

    record_kind: str
    rows: DataFrame
    key: str
    compared: tuple[str, ...]
    repository: str = "repository_id"
    commit: str = "commit_sha"
    stamp: str = "delivered_at"

    def records(self) -> DataFrame:
        """(record_kind, repo, sha, key, stamp, h); rows without an identity are left out."""
        h = null_safe_hash(*self.compared)
        out = self.rows.select(
            F.lit(self.record_kind).alias("record_kind"),
            F.col(self.repository).alias("repo"),
            F.col(self.commit).alias("sha"),
            F.col(self.key).alias("key"),
            F.col(self.stamp).alias("stamp"),
            h.alias("h"),
        )
        return out.where("repo is not null and sha is not null and key is not null")


def first_parents(commits: DataFrame) -> DataFrame:
    """(repo, sha, parent) from a commit table with ``parents`` as a JSON list, first parent first."""
    return (
        commits.select(
            F.col("repository_id").alias("repo"),
            "sha",
            F.get_json_object("parents", "$[0]").alias("parent"),
        )
        .where("repo is not null and sha is not null")
        .groupBy("repo", "sha")
        .agg(F.min("parent").alias("parent"))
    )


def _follow(pointers: DataFrame, label: str) -> DataFrame:
    """Pointer doubling over (record_kind, repo, sha, at, steps, done).

    Every row points ``at`` another row of its group until it is done; a row
    that points at no known row ends with a null ``at``.
    """
    now = materialize(pointers, label)
    for _ in range(MAX_ROUNDS):
        if now.where("not done").isEmpty():
            return now
        other = now.select("record_kind", "repo", F.col("sha").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        done, going = now.where("done"), now.where("not done")
        jumped = going.join(other, ["record_kind", "repo", "at"], "left").select(
            "record_kind",
            "repo",
            "sha",
            F.col("at2").alias("at"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            F.coalesce("done2", F.lit(True)).alias("done"),
        )
        after = materialize(done.unionByName(jumped), label)
        release(now)
        now = after
    raise ValueError("the first parents of some commit form a cycle")


def previous_snapshots(snapshots: DataFrame, parents: DataFrame, kinds: list[str]) -> DataFrame:
    """(record_kind, repo, sha, prev): each snapshot and the one before it, null at the start.

    ``snapshots`` has (record_kind, repo, sha). A parent that delivered rows
    counts even where the commit table does not list it.
    """
    has = snapshots.withColumn("has", F.lit(True))
    nodes = parents.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("record_kind"), "repo", "sha", F.col("parent").alias("at"))
    known = has.select("record_kind", "repo", F.col("sha").alias("at"), "has")
    start = nodes.join(known, ["record_kind", "repo", "at"], "left").select(
        "record_kind", "repo", "sha", "at", F.lit(0).alias("steps"), (F.col("at").isNull() | F.col("has").isNotNull()).alias("done")
    )
    ends = _follow(start, "ancestor")
    # a pointer that ran out at a commit without rows means: no snapshot before
    return snapshots.join(ends.select("record_kind", "repo", "sha", F.col("at").alias("prev")), ["record_kind", "repo", "sha"], "left")


def chains(previous: DataFrame) -> DataFrame:
    """Cut the snapshot forest into chains.

    Result: (record_kind, repo, sha, chain, seq, last, seed). Where several
    snapshots follow one, the smallest sha continues its chain and every other
    starts a chain of its own, with the snapshot before it repeated there as
    ``seed`` at seq 0. In a chain each seq follows the one before.
    """
    w = Window.partitionBy("record_kind", "repo", "prev").orderBy("sha")
    marked = previous.withColumn("head", F.col("prev").isNull() | (F.row_number().over(w) > 1))
    marked = materialize(marked, "snapshots")
    start = marked.select(
        "record_kind",
        "repo",
        "sha",
        F.when(F.col("head"), F.col("sha")).otherwise(F.col("prev")).alias("at"),
        F.when(F.col("head"), 0).otherwise(1).alias("steps"),
        F.col("head").alias("done"),
    )
    ranked = _follow(start, "rank").select("record_kind", "repo", "sha", F.col("at").alias("head_sha"), "steps")
    heads = marked.where("head").select("record_kind", "repo", F.col("sha").alias("head_sha"), F.col("prev").alias("seed_sha"))
    heads = materialize(heads.withColumn("chain", F.monotonically_increasing_id()), "heads")
    placed = ranked.join(heads, ["record_kind", "repo", "head_sha"])
    own = placed.select(
        "record_kind", "repo", "sha", "chain", (F.col("steps") + F.when(F.col("seed_sha").isNull(), 0).otherwise(1)).alias("seq"), F.lit(False).alias("seed")
    )
    seeds = heads.where("seed_sha is not null").select("record_kind", "repo", F.col("seed_sha").alias("sha"), "chain", F.lit(0).alias("seq"), F.lit(True).alias("seed"))
    both = own.unionByName(seeds)
    return materialize(both.withColumn("last", F.max("seq").over(Window.partitionBy("chain"))), "chains")


def validity_intervals(tables: list[SnapshotTable], parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gaps and islands: (chain, key, h, valid_from, valid_to, last), and the chains.

    An interval is a longest run of consecutive snapshots of one chain in which
    the record stands with one row hash. Of rows with one key in one snapshot
    the latest delivery counts; equal stamps are settled by the greater hash.
    """
    records = tables[0].records()
    for t in tables[1:]:
        records = records.unionByName(t.records())
    placed = chains(previous_snapshots(records.select("record_kind", "repo", "sha").distinct(), parents, [t.record_kind for t in tables]))
    where = broadcast_if_small(placed.select("record_kind", "repo", "sha", "chain", "seq", "last"), placed.count())
    rows = records.join(where, ["record_kind", "repo", "sha"]).select("chain", "key", "seq", "stamp", "h", "last").repartition("chain", "key")

    def by(*order: str) -> Window:
        return Window.partitionBy("chain", "key").orderBy(*order)

    deliveries = by("seq", "stamp", "h")
    rows = rows.withColumn("later", F.lead("seq").over(deliveries)).where("later is null or later <> seq")
    w = by("seq")
    rows = (
        rows.withColumn("starts", F.coalesce((F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("h").over(w) == F.col("h")), F.lit(False)) == F.lit(False))
        .withColumn("ends", F.coalesce((F.lead("seq").over(w) == F.col("seq") + 1) & (F.lead("h").over(w) == F.col("h")), F.lit(False)) == F.lit(False))
        .where("starts or ends")
    )
    # of the rows kept, the one after a start that does not end itself is its end
    rows = rows.withColumn("valid_to", F.when(F.col("ends"), F.col("seq")).otherwise(F.lead("seq").over(w))).where("starts")
    return rows.select("chain", "key", "h", F.col("seq").alias("valid_from"), "valid_to", "last"), placed


def snapshot_changes(tables: list[SnapshotTable], commits: DataFrame) -> DataFrame:
    """Change events between each snapshot and the one before it.

    Result: (record_kind, repository_id, commit_sha, record_id, change_kind),
    change_kind being ``added``, ``removed`` or ``changed`` and commit_sha the
    later snapshot. A snapshot without one before it gives no rows. Rows with a
    null repository, commit or key are left out; a null among the compared
    columns is a value of its own. Repeated rows count once, empty tables give
    no events, and further columns of the tables are not read.
    """
    intervals, placed = validity_intervals(tables, first_parents(commits))
    w = Window.partitionBy("chain", "key").orderBy("valid_from")
    before, after = F.lag("valid_to").over(w), F.lead("valid_from").over(w)
    start = F.when(F.col("valid_from") > 0, F.when(before == F.col("valid_from") - 1, F.lit("changed")).otherwise(F.lit("added")))
    end = F.when((F.col("valid_to") < F.col("last")) & F.coalesce(after > F.col("valid_to") + 1, F.lit(True)), F.lit("removed"))
    events = intervals.select(
        "chain",
        "key",
        F.array(
            F.struct(start.alias("change_kind"), F.col("valid_from").alias("seq")),
            F.struct(end.alias("change_kind"), (F.col("valid_to") + 1).alias("seq")),
        ).alias("events"),
    )
    events = events.select("chain", "key", F.inline("events")).where("change_kind is not null")
    names = placed.where("not seed").select("chain", "seq", "record_kind", "repo", "sha")
    names = broadcast_if_small(names, names.count())
    return events.join(names, ["chain", "seq"]).select(
        "record_kind", F.col("repo").alias("repository_id"), F.col("sha").alias("commit_sha"), F.col("key").alias("record_id"), "change_kind"
    )
