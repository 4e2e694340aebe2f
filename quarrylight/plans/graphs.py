"""Queries over the dependency graphs of all repositories and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import paths
from quarrylight.operators import graph
from quarrylight.plans.pipeline import counting_edges
from quarrylight.storage import materialize

#: fixed values: kinds of edges that state a dependency
DEPENDS = ("calls", "imports", "uses", "references", "extends")


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """(g, src, dst): different dependencies of every commit's graph; g is repository@commit."""
    e = counting_edges(spark, folder, "kind", "source_id", "target_id").where(F.lower(F.trim("kind")).isin(*DEPENDS))
    named = e.select(F.concat_ws("@", "repository_id", "commit_sha").alias("g"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return materialize(graph.simple(named), "dependencies")


def kind_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = counting_edges(spark, folder, "kind", "source_id", "target_id", "weight")
    return e.select(F.concat_ws("@", "repository_id", "commit_sha").alias("g"), F.lower(F.trim("kind")).alias("kind"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight", "edge_id")


E_SQL = """live as (select repository_id || '@' || commit_sha as g, lower(trim(kind)) as kind, source_id as src, target_id as dst, weight, edge_id from (
  select *, row_number() over (partition by repository_id, commit_sha, edge_id order by delivered_at desc) rn from ria_graph_edge) where rn = 1),
e as materialized (select distinct g, src, dst from live where kind in ('calls','imports','uses','references','extends')),
ends as (select g, src as node from e union all select g, dst from e), nodes as materialized (select distinct g, node from ends),
outs as (select g, src as start, row_number() over (partition by g order by count(*) desc, src) as r from e group by g, src),
so as (select g, start from outs where r = 1),
ins as (select g, dst as start, row_number() over (partition by g order by count(*) desc, dst) as r from e group by g, dst),
si as (select g, start from ins where r = 1),
every as (select g, node as start from nodes), sizes as (select g, count(*) as n from nodes group by g)"""

_DEG = """deg as (select g, node, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select g, src as node, 0 as i, 1 as o from e union all select g, dst, 1, 0 from e) group by all),
sz as (select g, count(*) as n from nodes group by g),
cen as (select d.g, node, fan_in, fan_out, case when n > 1 then (fan_in + fan_out) / (n - 1) else 0.0 end as centrality from deg d join sz using (g))"""

_Q: dict = {}
_O: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql:
            _O[name] = sql
        return f

    return keep


def every_node(e: DataFrame) -> DataFrame:
    """(g, start): each node of each graph."""
    return graph.nodes(e).withColumnRenamed("node", "start")


# a shortest path has fewer steps than its graph has nodes
_WALK = f"""with recursive {E_SQL}, w as (select g, start, start as node, 0 as depth from every
  union select w.g, w.start, e.dst, w.depth + 1 from w join e on e.g = w.g and e.src = w.node join sizes z on z.g = w.g where w.depth < z.n),
b as materialized (select g, start, node, min(depth) as depth from w group by all)"""


@query("g01_bfs", f"{_WALK} select * from b")
def g01_bfs(s: SparkSession, d: str) -> DataFrame:
    """Breadth first from every node of each graph, over any number of levels."""
    e = dependencies(s, d)
    return graph.reach(e, None)


@query("g02_reverse_bfs", f"{_WALK} select g, node as start, start as node, depth from b where node <> start")
def g02_reverse_bfs(s: SparkSession, d: str) -> DataFrame:
    """Who depends on each node, over any number of steps, the start left out."""
    e = dependencies(s, d)
    return graph.reach(graph.reverse(e), None).where("node <> start")


@query("g04_closure", f"""with recursive {E_SQL}, w as (select g, start, start as node from every union select w.g, w.start, e.dst from w join e on e.g = w.g and e.src = w.node)
select g, start, count(*) - 1 as reached from w group by all""")
def g04_closure(s: SparkSession, d: str) -> DataFrame:
    """How many nodes each node reaches over any number of steps."""
    e = dependencies(s, d)
    return graph.reach_counts(e)


_PATHS = f"""{_WALK}, p as (select g, start, start as node, 0 as depth, [start] as path from every
  union all select p.g, p.start, e.dst, p.depth + 1, min(list_append(p.path, e.dst)) from p join e on e.g = p.g and e.src = p.node
    join b on b.g = p.g and b.start = p.start and b.node = e.dst and b.depth = p.depth + 1 group by all)"""


@query("g05_shortest_paths", f"{_PATHS} select g, start, node, depth, array_to_string(path, ' > ') as path from p")
def g05_shortest_paths(s: SparkSession, d: str) -> DataFrame:
    """The smallest shortest path from every node to all it reaches, without a bound."""
    e = dependencies(s, d)
    return graph.reach(e, None, paths=True, joined=" > ")


@query("g07_strong_components", f"""with recursive {E_SQL}, e2 as (select * from e where src <> dst), w as (select g, src as a, dst as b from e2 union select w.g, w.a, e2.dst from w join e2 on e2.g = w.g and e2.src = w.b)
select x.g, x.a as node, least(x.a, min(x.b)) as component from w x join w y on x.g = y.g and x.a = y.b and x.b = y.a where x.a <> x.b group by x.g, x.a""")
def g07_strong_components(s: SparkSession, d: str) -> DataFrame:
    """Strongly connected parts of two nodes or more."""
    return graph.strong_components(dependencies(s, d))


@query("g08_cycle_summary", f"""with recursive {E_SQL}, e2 as (select * from e where src <> dst), w as (select g, src as a, dst as b from e2 union select w.g, w.a, e2.dst from w join e2 on e2.g = w.g and e2.src = w.b),
c as (select x.g, x.a as node, least(x.a, min(x.b)) as component from w x join w y on x.g = y.g and x.a = y.b and x.b = y.a where x.a <> x.b group by x.g, x.a),
p as (select g, count(distinct component) as components, count(*) as cyclic_nodes from c group by g), l as (select g, count(*) as self_loops from e where src = dst group by g)
select g, coalesce(components, 0) as components, coalesce(cyclic_nodes, 0) as cyclic_nodes, coalesce(self_loops, 0) as self_loops from p full join l using (g)""")
def g08_cycle_summary(s: SparkSession, d: str) -> DataFrame:
    """Cyclic parts, cyclic nodes and self loops of each graph."""
    return graph.cycle_summary(dependencies(s, d))


@query("g08_short_cycles", f"""with {E_SQL} select g, src as cycle from e where src = dst
union all select a.g, a.src || ' > ' || a.dst from e a join e b on a.g = b.g and a.dst = b.src and a.src = b.dst where a.src < a.dst
union all select a.g, a.src || ' > ' || a.dst || ' > ' || b.dst from e a join e b on a.g = b.g and a.dst = b.src join e c on c.g = a.g and c.src = b.dst and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst""")
def g08_short_cycles(s: SparkSession, d: str) -> DataFrame:
    """Simple cycles of up to three nodes from their least node."""
    return graph.short_cycles(dependencies(s, d), 3).select("g", F.array_join("cycle", " > ").alias("cycle"))


@query("g09_blast_radius", f"""with recursive {E_SQL}, w as (select g, start, start as node, 0 as depth from every union select w.g, w.start, e.src, w.depth + 1 from w join e on e.g = w.g and e.dst = w.node where w.depth < 10),
n as (select g, start, count(distinct node) filter (node <> start) as affected from w group by all)
select g, start, affected, case when affected >= 20 then 'high' when affected >= 5 then 'medium' else 'low' end as risk from n""")
def g09_blast_radius(s: SparkSession, d: str) -> DataFrame:
    """What a change of each node affects within ten steps, with a risk label."""
    e = dependencies(s, d)
    return graph.blast_radius(e, every_node(e))


@query("g10_call_tree", f"""with recursive {E_SQL}, w as (select g, start, start as node, 0 as depth, [start] as path, false as back_edge from so
  union all select w.g, w.start, e.dst, w.depth + 1, list_append(w.path, e.dst), list_contains(w.path, e.dst) from w join e on e.g = w.g and e.src = w.node where w.depth < 8 and not w.back_edge)
select g, start, array_to_string(path, ' > ') as path, depth, back_edge from w""")
def g10_call_tree(s: SparkSession, d: str) -> DataFrame:
    """The tree of dependencies of the node with the most of them in each graph, to a depth of eight, repeats on a path marked."""
    e = dependencies(s, d)
    return graph.call_tree(e, graph.small_starts(e), 8).withColumn("path", F.array_join("path", " > "))


@query("g11_neighbours", f"""with {E_SQL} select e.g, start, 'out' as direction, dst as node from e join every v on e.g = v.g and e.src = v.start
union select e.g, start, 'in', src from e join every v on e.g = v.g and e.dst = v.start""")
def g11_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Direct predecessors and successors of each node."""
    e = dependencies(s, d)
    return graph.neighbours(e, every_node(e))


@query("g14_module_blast", f"""with recursive {E_SQL}, w as (select e.g, start, e.src as node from every v join e on e.g = v.g and e.dst = v.start union select w.g, w.start, e.src from w join e on e.g = w.g and e.dst = w.node),
n as (select g, start, count(*) as total, count_if(contains(lower(node), 'api') or contains(lower(node), 'router')) as apis, count_if(contains(lower(node), 'service')) as services,
  count_if(contains(lower(node), 'test') or contains(lower(node), 'spec')) as tests from w group by all)
select v.g, v.start, coalesce(total, 0) as total, coalesce(apis, 0)::bigint as apis, coalesce(services, 0)::bigint as services, coalesce(tests, 0)::bigint as tests, case when total > 15 or apis > 3 then 'Critical' when total > 8 then 'High' when total > 3 then 'Medium' else 'Low' end as risk,
  least(100, coalesce(total, 0) * 5) as percent from every v left join n using (g, start)""")
def g14_module_blast(s: SparkSession, d: str) -> DataFrame:
    """All consumers of each node with parts by name, risk and percentage."""
    e = dependencies(s, d)
    return graph.module_blast(e, every_node(e))


@query("g15_dead_code", f"""with recursive {E_SQL}, {_DEG}, r as (select g, start as node from so union select r.g, e.dst from r join e on e.g = r.g and e.src = r.node),
lost as (select * from nodes except select * from r), inner_ as (select e.* from e semi join lost a on a.g = e.g and a.node = e.src semi join lost b on b.g = e.g and b.node = e.dst),
w as (select g, node as start, node from lost union select w.g, w.start, i.dst from w join inner_ i on i.g = w.g and i.src = w.node),
below as (select g, start as node, count(*) - 1 as below from w group by all)
select l.g, l.node, case when fan_in = 0 then 'unused' else 'orphan' end as status, case when fan_in = 0 then 0.95 else 0.90 end::double as confidence, 1 + 10 * centrality + 0.5 * fan_out + below as weight
from lost l join cen using (g, node) join below using (g, node)""")
def g15_dead_code(s: SparkSession, d: str) -> DataFrame:
    """Nodes that the start of each graph does not reach, with status and weight."""
    e = dependencies(s, d)
    return graph.dead_code(e, graph.small_starts(e).withColumnRenamed("start", "node"))


@query("g16_weak_components", f"""with recursive {E_SQL}, u as (select g, src, dst from e union select g, dst, src from e), w as (select g, node, node as m from nodes union select w.g, u.dst, w.m from w join u on u.g = w.g and u.src = w.node)
select g, node, min(m) as component from w group by all""")
def g16_weak_components(s: SparkSession, d: str) -> DataFrame:
    """The connected part of each node without regard to direction."""
    return graph.weak_components(dependencies(s, d))


@query("g17_nearest_reachable", f"""with recursive {E_SQL}, r as (select g, start as node from so union select r.g, e.dst from r join e on e.g = r.g and e.src = r.node),
lost as (select * from nodes except select * from r), u as (select g, src, dst from e union select g, dst, src from e),
w as (select g, node, node as nearest, 0 as depth from r union select w.g, u.dst, w.nearest, w.depth + 1 from w join u on u.g = w.g and u.src = w.node where w.depth < 16),
b as (select g, node, min(depth) as depth from w group by all), n as (select b.g, b.node, min(w.nearest) as nearest, b.depth from b join w using (g, node, depth) group by all)
select l.g, l.node, n.nearest, n.depth from lost l left join n using (g, node)""")
def g17_nearest_reachable(s: SparkSession, d: str) -> DataFrame:
    """For each node the start does not reach, the nearest one it does."""
    e = dependencies(s, d)
    live = materialize(graph.reachable_set(e, graph.small_starts(e).withColumnRenamed("start", "node")), "live")
    lost = graph.nodes(e).join(live, ["g", "node"], "left_anti")
    return graph.nearest_reachable(e, live, lost)


@query("g18_ego", f"""with recursive {E_SQL}, u as (select g, src, dst from e union select g, dst, src from e), w as (select g, start, start as node, 0 as depth from every union select w.g, w.start, u.dst, w.depth + 1 from w join u on u.g = w.g and u.src = w.node where w.depth < 2)
select g, start, node, min(depth) as depth from w group by all""")
def g18_ego(s: SparkSession, d: str) -> DataFrame:
    """Two steps around each node in both directions."""
    e = dependencies(s, d)
    return graph.ego(e, every_node(e), 2)


@query("g28_levels", """with recursive t as (select 0::bigint as node, 0 as level union all select p.p_partkey, t.level + 1 from t join part p on p.p_partkey // 2 = t.node and p.p_partkey > 0)
select 'parts' as g, node, level from t""")
def g28_levels(s: SparkSession, d: str) -> DataFrame:
    """Topological levels of the parts' hierarchy (a part's parent is half its key)."""
    part = s.read.parquet(f"{d}/part.parquet").where("p_partkey > 0")
    return graph.levels(part.select(F.lit("parts").alias("g"), F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst")))


@query("j28_mutual", f"with {E_SQL} select a.g, a.src as a, a.dst as b from e a join e b on a.g = b.g and a.src = b.dst and a.dst = b.src where a.src < a.dst")
def j28_mutual(s: SparkSession, d: str) -> DataFrame:
    """Nodes that depend on each other."""
    return graph.mutual(dependencies(s, d))


@query("a06_statistics", f"with {E_SQL} select g, n as nodes, m as edges, case when n > 1 then m / (n * (n - 1)) else 0.0 end as density from (select g, count(*) as n from nodes group by g) join (select g, count(*) as m from e group by g) using (g)")
def a06_statistics(s: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and density of each graph."""
    return graph.statistics(dependencies(s, d))


@query("a10_centrality", f"with {E_SQL}, {_DEG} select * from cen")
def a10_centrality(s: SparkSession, d: str) -> DataFrame:
    """Fan-in, fan-out and degree centrality of each node."""
    return graph.centrality(dependencies(s, d))


@query("a14_kind_histogram", f"with {E_SQL} select kind, count(*) as edges, count(distinct g) as graphs, round(avg(weight), 6) as mean_weight from live group by kind")
def a14_kind_histogram(s: SparkSession, d: str) -> DataFrame:
    """Edges by kind over all graphs."""
    return kind_edges(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("g").alias("graphs"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("w01_reading_order", f"""with {E_SQL}, {_DEG}, x as (select c.*, max(fan_in) over (partition by c.g) as top, so.start is not null as entry from cen c left join so on so.g = c.g and so.start = c.node)
select g, node, round(case when entry then 100.0 else 0.0 end + 50 * centrality + case when top > 0 then 30 * fan_in / top else 0.0 end
 + case when regexp_matches(node, '(^|[/:])(core|src|lib|app|services?|domain)/') then 15.0 else 0.0 end - case when regexp_matches(node, '(^|[/:])(tests?|docs?|examples?|scripts|benchmarks)/') then 40.0 else 0.0 end, 6) as score from x""")
def w01_reading_order(s: SparkSession, d: str) -> DataFrame:
    """How early each node should be read."""
    e = dependencies(s, d)
    out = graph.reading_scores(e, graph.small_starts(e).withColumnRenamed("start", "node"))
    return out.withColumn("score", F.round("score", 6))


@query("p16_call_subgraph", f"""with {E_SQL} select distinct g, src, dst from live where kind = 'calls' and src like 'file:%' and dst like 'file:%'""")
def p16_call_subgraph(s: SparkSession, d: str) -> DataFrame:
    """The call graph among file nodes, an induced projection."""
    e = kind_edges(s, d)
    keep = graph.nodes(e).where("node like 'file:%'")
    return graph.induced(e.where("kind = 'calls'").select("g", "src", "dst").distinct(), keep)


@query("p19_layer_rules", None)
def p19_layer_rules(s: SparkSession, d: str) -> DataFrame:
    """Dependencies that break a layer rule, with rule and severity."""
    e = dependencies(s, d)
    out = e.select("g", "src", "dst", F.explode(paths.basic_layer_violation(F.col("src"), F.col("dst"))).alias("rule"))
    severity = F.create_map(*[F.lit(x) for kv in paths.SEVERITY_OF_RULE.items() for x in kv])
    return out.withColumn("severity", severity[F.col("rule")])


@query("a16_rollup", f"""with {E_SQL} select coalesce(kind, 'all') as kind, case when grouping(tier) = 1 then 'all' else tier end as tier, count(*) as edges
 from (select kind, case when src like 'file:%' then 'file' when src like 'package:%' then 'package' else 'other' end as tier from live) group by rollup (kind, tier)""")
def a16_rollup(s: SparkSession, d: str) -> DataFrame:
    """Edges by kind and node type with subtotals."""
    e = kind_edges(s, d).select("kind", F.when(F.col("src").like("file:%"), "file").when(F.col("src").like("package:%"), "package").otherwise("other").alias("tier"))
    return e.rollup("kind", "tier").agg(F.count(F.lit(1)).alias("edges"), F.grouping("tier").alias("gt")).select(F.coalesce("kind", F.lit("all")).alias("kind"), F.when(F.col("gt") == 1, "all").otherwise(F.col("tier")).alias("tier"), "edges")


QUERIES, ORACLES = _Q, _O
