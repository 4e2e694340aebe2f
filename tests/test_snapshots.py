"""Problem 6: change events against a comparison of each pair of snapshots."""

from __future__ import annotations

import datetime as dt
import random

from quarrylight.operators.snapshots import SnapshotTable, snapshot_changes

FILE = "repository_id string, commit_sha string, path string, content_hash string, delivered_at timestamp, seq int, chain string"
COMMIT = "repository_id string, sha string, parents string"
T0 = dt.datetime(2024, 1, 1)


def run(spark, rows, commits, kind="file"):
    df = spark.createDataFrame(rows, FILE)
    c = spark.createDataFrame(commits, COMMIT)
    return {(x.record_kind, x.repository_id, x.commit_sha, x.record_id, x.change_kind) for x in snapshot_changes([SnapshotTable(kind, df, "path", ("content_hash",))], c).collect()}


def brute(rows, commits):
    latest = {}
    for r, c, p, h, at, *_ in rows:
        if None not in (r, c, p) and ((r, c, p) not in latest or at > latest[(r, c, p)][0]):
            latest[(r, c, p)] = (at, h)
    snap = {}
    for (r, c, p), (_, h) in latest.items():
        snap.setdefault((r, c), {})[p] = h
    first = {(r, s): (p.split('"')[1] if '"' in p else None) for r, s, p in commits}
    out = set()
    for (r, c), now in snap.items():
        a = first.get((r, c))
        while a is not None and (r, a) not in snap:
            a = first.get((r, a))
        if a is None:
            continue
        old = snap[(r, a)]
        out |= {("file", r, c, p, "added") for p in now.keys() - old.keys()} | {("file", r, c, p, "removed") for p in old.keys() - now.keys()}
        out |= {("file", r, c, p, "changed") for p in now.keys() & old.keys() if now[p] != old[p]}
    return out


def test_random_histories_with_branches_gaps_and_redeliveries(spark):
    rnd = random.Random(5)
    commits, rows = [], []
    for r in ("r1", "r2"):
        for i in range(14):
            parent = None if i == 0 else max(0, i - rnd.choice([1, 1, 1, 2, 4]))
            commits.append((r, f"c{i:02d}", "[]" if parent is None else f'["c{parent:02d}", "zz"]'))
            if rnd.random() < 0.75:
                for p in range(12):
                    if rnd.random() < 0.7:
                        at = T0 + dt.timedelta(days=i)
                        rows.append((r, f"c{i:02d}", f"p{p}", f"h{rnd.randrange(3)}" if rnd.random() > 0.1 else None, at, 1, "x"))
                        if rnd.random() < 0.2:
                            rows.append((r, f"c{i:02d}", f"p{p}", f"h{rnd.randrange(3)}", at + dt.timedelta(hours=rnd.choice([-5, 5])), 2, "y"))
    assert run(spark, rows, commits) == brute(rows, commits)


def test_parent_without_a_commit_row_still_counts(spark):
    rows = [("r", "a", "p", "1", T0, 0, ""), ("r", "b", "p", "2", T0, 0, "")]
    assert run(spark, rows, [("r", "b", '["a"]')]) == {("file", "r", "b", "p", "changed")}


def test_nulls_empty_tables_and_no_commits(spark):
    rows = [("r", "a", "p", "1", T0, 0, ""), ("r", "b", None, "2", T0, 0, ""), (None, "b", "p", "2", T0, 0, ""), ("r", "b", "q", "2", None, 0, "")]
    assert run(spark, rows, [("r", "b", '["a"]'), ("r", "a", None)]) == {("file", "r", "b", "p", "removed"), ("file", "r", "b", "q", "added")}
    assert run(spark, [], [("r", "b", '["a"]')]) == set()
    assert run(spark, rows, []) == set()
