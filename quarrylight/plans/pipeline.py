"""Queries for problems 1 and 6, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.hierarchy import Hierarchy, further_parents, parent_links
from quarrylight.operators.snapshots import SnapshotTable, first_parents, snapshot_changes, validity_intervals
from quarrylight.storage import table


def counting_edges(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The edges that count: of each key the latest delivery."""
    key = ["repository_id", "commit_sha", "edge_id"]
    edges = table(spark, folder, "ria_graph_edge").select(*key, *columns, "delivered_at")
    # greatest (delivered_at, columns) of each key; aggregates combine before the shuffle
    best = F.max(F.struct("delivered_at", *columns)).alias("best")
    return edges.groupBy(*key).agg(best).select(*key, *[f"best.{c}" for c in columns])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes whose way from child to parent ends in a cycle."""
    return Hierarchy(parent_links(counting_edges(spark, folder, "kind", "source_id", "target_id")), paths=False).cyclic()


def _whole(spark: SparkSession, folder: str) -> Hierarchy:
    return Hierarchy(parent_links(counting_edges(spark, folder, "kind", "source_id", "target_id")))


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every node with a root: its depth, root and path (ids joined by a line feed)."""
    return _whole(spark, folder).nodes().select("repository_id", "commit_sha", "node_id", "depth", "root_id", F.array_join("path", "\n").alias("path"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """For each node with children and a root: number of descendants and greatest distance to one; :func:`p1_descendant_list` names them."""
    pairs = _whole(spark, folder).ancestor_pairs()
    return pairs.groupBy("repository_id", "commit_sha", "node_id").agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height"))


def p1_descendant_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every descendant of every node and its distance, of nodes without a root as well."""
    whole = _whole(spark, folder)
    return whole.ancestor_pairs().unionByName(whole.rootless_pairs())


def p1_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with several parents: each of these links, and whether the trees follow it."""
    return further_parents(counting_edges(spark, folder, "kind", "source_id", "target_id"))


def _snapshot_tables(spark: SparkSession, folder: str) -> list[SnapshotTable]:
    return [
        SnapshotTable("file", table(spark, folder, "ria_file_unit"), "path", ("content_hash",)),
        SnapshotTable("edge", table(spark, folder, "ria_graph_edge"), "edge_id", ("source_id", "target_id", "weight")),
    ]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Added, removed and changed records between each snapshot and the one before it."""
    return snapshot_changes(_snapshot_tables(spark, folder), table(spark, folder, "ria_commit"))


def p6_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Change events counted by commit and kind."""
    return p6_found(spark, folder).groupBy("record_kind", "repository_id", "commit_sha", "change_kind").agg(F.count(F.lit(1)).alias("records"))


_LATEST_EDGE = """select * exclude (rn) from (select *, row_number() over (partition by repository_id, commit_sha, edge_id
  order by delivered_at desc) as rn from ria_graph_edge) where rn = 1"""

_LINKS = f"""links as materialized (select repository_id, commit_sha, n, min(p) as p from (
  select repository_id, commit_sha,
    case when lower(trim(kind)) in ('contains','owns','declares') then target_id else source_id end as n,
    case when lower(trim(kind)) in ('contains','owns','declares') then source_id else target_id end as p
  from ({_LATEST_EDGE}) where lower(trim(kind)) in ('contains','owns','declares','belongs_to','defined_in'))
  where n is not null and p is not null group by all),
roots as materialized (select distinct l.repository_id, l.commit_sha, l.p as n from links l anti join links k
  on l.repository_id = k.repository_id and l.commit_sha = k.commit_sha and l.p = k.n),
tree as (select repository_id, commit_sha, n, 0 as depth, n as root, n as path from roots
  union all select l.repository_id, l.commit_sha, l.n, t.depth + 1, t.root, t.path || chr(10) || l.n
  from tree t join links l on l.repository_id = t.repository_id and l.commit_sha = t.commit_sha and l.p = t.n)"""

_CHANGES = f"""with recursive files as (select repository_id, commit_sha, path as k, content_hash as h from (select *, row_number() over (
    partition by repository_id, commit_sha, path order by delivered_at desc) rn from ria_file_unit) where rn = 1),
edges as (select repository_id, commit_sha, edge_id as k, (source_id || chr(10) || target_id || chr(10) || weight::varchar) as h from ({_LATEST_EDGE})),
rows_ as materialized (select 'file' as record_kind, * from files union all select 'edge', * from edges),
snaps as materialized (select distinct record_kind, repository_id, commit_sha from rows_),
step as materialized (select repository_id, sha, parents->>'$[0]' as parent from ria_commit),
walk as (select s.record_kind, s.repository_id, s.commit_sha, c.parent as at from snaps s join step c
    on c.repository_id = s.repository_id and c.sha = s.commit_sha
  union all select w.record_kind, w.repository_id, w.commit_sha, c.parent from walk w
    join step c on c.repository_id = w.repository_id and c.sha = w.at
    where not exists (select 1 from snaps s where s.record_kind = w.record_kind and s.repository_id = w.repository_id and s.commit_sha = w.at)),
prev as (select w.* from walk w join snaps s on s.record_kind = w.record_kind and s.repository_id = w.repository_id and s.commit_sha = w.at),
now_ as (select p.record_kind, p.repository_id, p.commit_sha, r.k, r.h from prev p join rows_ r using (record_kind, repository_id, commit_sha)),
old_ as (select p.record_kind, p.repository_id, p.commit_sha, r.k, r.h from prev p join rows_ r
  on r.record_kind = p.record_kind and r.repository_id = p.repository_id and r.commit_sha = p.at),
changes as (select record_kind, repository_id, commit_sha, k as record_id,
  case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end as change_kind
  from (select *, k as kk from now_) n full join (select *, k as kk from old_) o using (record_kind, repository_id, commit_sha, k)
  where n.kk is null or o.kk is null or n.h is distinct from o.h)"""
_CHANGES = _CHANGES.replace("o.k is null then", "o.kk is null then").replace("n.k is null then", "n.kk is null then")

QUERIES = {
    "p1_found": p1_found,
    "p1_hierarchy": p1_hierarchy,
    "p1_descendants": p1_descendants,
    "p1_descendant_list": p1_descendant_list,
    "p1_conflicts": p1_conflicts,
    "p6_found": p6_found,
    "p6_change_counts": p6_change_counts,
}

ORACLES = {
    "p1_found": f"""with recursive {_LINKS},
bad as materialized (select l.* from links l anti join tree t on t.repository_id = l.repository_id and t.commit_sha = l.commit_sha and t.n = l.n),
up as (select repository_id, commit_sha, n, p as top from bad
  union select u.repository_id, u.commit_sha, u.n, b.p from up u join bad b on b.repository_id = u.repository_id and b.commit_sha = u.commit_sha and b.n = u.top),
oncycle as (select distinct repository_id, commit_sha, n from up where top = n)
select u.repository_id, u.commit_sha, u.n as node_id, min(u.top) as cycle_head from up u join oncycle c
  on c.repository_id = u.repository_id and c.commit_sha = u.commit_sha and c.n = u.top group by all""",
    "p1_hierarchy": f"with recursive {_LINKS} select repository_id, commit_sha, n as node_id, depth, root as root_id, path from tree",
    "p1_descendants": f"""with recursive {_LINKS},
up as (select repository_id, commit_sha, n, depth, path from tree),
pairs as (select repository_id, commit_sha, unnest(string_split(path, chr(10))) as a, unnest(range(0, depth + 1)) as i, depth from up)
select repository_id, commit_sha, a as node_id, count(*) as descendants, max(depth - i)::int as height from pairs where i < depth group by all""",
    "p1_descendant_list": f"""with recursive {_LINKS},
up as (select repository_id, commit_sha, p as node_id, n as descendant_id, 1 as distance, [n, p] as way from links where p <> n
  union all select u.repository_id, u.commit_sha, l.p, u.descendant_id, u.distance + 1, list_append(u.way, l.p) from up u join links l
    on l.repository_id = u.repository_id and l.commit_sha = u.commit_sha and l.n = u.node_id where not list_contains(u.way, l.p))
select repository_id, commit_sha, node_id, descendant_id, distance from up""",
    "p1_conflicts": f"""with l as (select distinct repository_id, commit_sha,
      case when lower(trim(kind)) in ('contains','owns','declares') then target_id else source_id end as node_id,
      case when lower(trim(kind)) in ('contains','owns','declares') then source_id else target_id end as parent_id
      from ({_LATEST_EDGE}) where lower(trim(kind)) in ('contains','owns','declares','belongs_to','defined_in')),
    m as (select *, min(parent_id) over w as least, max(parent_id) over w as most from l where node_id is not null and parent_id is not null window w as (partition by repository_id, commit_sha, node_id))
    select repository_id, commit_sha, node_id, parent_id, parent_id = least as followed from m where least <> most""",
    "p6_found": f"{_CHANGES} select * from changes",
    "p6_change_counts": f"{_CHANGES} select record_kind, repository_id, commit_sha, change_kind, count(*) as records from changes group by all",
}
