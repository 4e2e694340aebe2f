"""Queries over the catalogue of symbols and relations, graph questions, scores, texts and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import api
from quarrylight.functions import paths, text
from quarrylight.operators import calls, context, diff, graph, history, knowledge, resolve, scoring, search
from quarrylight.plans.analytics import _CATEGORY, _F, _P, _findings
from quarrylight.plans.code import catalogue
from quarrylight.plans.graphs import _WALK, E_SQL, dependencies, every_node
from quarrylight.sources import files as source_files
from quarrylight.storage import materialize, shared_folder, table
from quarrylight.streaming import monitor

_Q: dict = {}
_O: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql:
            _O[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- questions to the catalogue

_PATH_OF = r"regexp_extract({}, '^\w+:[^:]*:([^#]*)', 1)"
_CAT = f"""live as materialized (select distinct repository_id, commit_sha, source_id as s, target_id as t, lower(trim(kind)) as kind from (
  select *, row_number() over (partition by repository_id, commit_sha, edge_id order by delivered_at desc) rn from ria_graph_edge) where rn = 1),
rel as materialized (select distinct repository_id, commit_sha, s as source, t as target, {_PATH_OF.format('s')} as path,
  case kind when 'calls' then 'CALLS' when 'imports' then 'IMPORTS' when 'extends' then 'INHERITS_FROM' when 'references' then 'REFERENCES' when 'uses' then 'REFERENCES' else 'DEFINES' end as kind from live),
sym as materialized (select repository_id, commit_sha, m as moniker, regexp_extract(m, '([^/#.:@]+)$', 1) as name, regexp_extract(m, '#(.*)$', 1) as qualified, {_PATH_OF.format('m')} as path
  from (select repository_id, commit_sha, s as m from live union select repository_id, commit_sha, t from live)),
called as (select target as m from rel where kind = 'CALLS' group by 1 order by count(*) desc, 1 limit 1),
calling as (select source as m from rel where kind = 'CALLS' group by 1 order by count(*) desc, 1 limit 1),
importing as (select path as m from rel where kind = 'IMPORTS' group by 1 order by count(*) desc, 1 limit 1)"""
_REL = "repository_id, commit_sha, source, target, kind"


def _most(f: api.Facts, kind: str, column: str) -> str:
    """The value with the most relations of a kind, ties to the least."""
    return f.r.where(F.col("kind") == kind).groupBy(column).count().orderBy(F.desc("count"), column).first()[column]


@query("q01_definition", f"with {_CAT} select repository_id, commit_sha, moniker, path from sym where name = (select regexp_extract(m, '([^/#.:@]+)$', 1) from called)")
def q01_definition(s: SparkSession, d: str) -> DataFrame:
    """Q01, Q06: where the name of the most called symbol is defined."""
    f = catalogue(s, d)
    name = _most(f, "CALLS", "target")
    import re

    return api.go_to_definition(f, re.search(r"([^/#.:@]+)$", name).group(1), 1000).select("repository_id", "commit_sha", "moniker", "path")


@query("q01_references", f"with {_CAT} select {_REL} from rel where kind in ('REFERENCES', 'CALLS') and source = (select m from calling)")
def q01_references(s: SparkSession, d: str) -> DataFrame:
    """What the symbol with the most calls refers to."""
    f = catalogue(s, d)
    return api.find_references(f, _most(f, "CALLS", "source"), 1000).select("repository_id", "commit_sha", "source", "target", "kind")


@query("q01_referrers", f"with {_CAT} select {_REL} from rel where kind in ('REFERENCES', 'CALLS') and target = (select m from called)")
def q01_referrers(s: SparkSession, d: str) -> DataFrame:
    """Who refers to the most called symbol."""
    f = catalogue(s, d)
    return api.find_referrers(f, _most(f, "CALLS", "target"), 1000).select("repository_id", "commit_sha", "source", "target", "kind")


@query("q02_plan", f"with {_CAT} select {_REL} from rel where kind = 'CALLS' and source = (select m from calling)")
def q02_plan(s: SparkSession, d: str) -> DataFrame:
    """A planned question, its limit brought into bounds."""
    f = catalogue(s, d)
    return api.Plan("FIND_CALLEES", _most(f, "CALLS", "source"), 1_000_000).run(f).select("repository_id", "commit_sha", "source", "target", "kind")


@query("q01_imports", f"with {_CAT} select {_REL} from rel where kind = 'IMPORTS' and path = (select m from importing)")
def q01_imports(s: SparkSession, d: str) -> DataFrame:
    """Q01: imports of the file with the most."""
    f = catalogue(s, d)
    return api.find_imports(f, _most(f, "IMPORTS", "path"), 1000).select("repository_id", "commit_sha", "source", "target", "kind")


@query("v33_dependencies", f"with {_CAT} select {_REL} from rel where path = (select m from importing)")
def v33_dependencies(s: SparkSession, d: str) -> DataFrame:
    """All relations of the symbols of one file."""
    f = catalogue(s, d)
    return api.dependency_analysis(f, _most(f, "IMPORTS", "path"), 1000).select("repository_id", "commit_sha", "source", "target", "kind")


@query("v12_modules", f"with {_CAT} select distinct path from sym where contains(lower(path), 'store') order by path limit 20")
def v12_modules(s: SparkSession, d: str) -> DataFrame:
    """Files whose path holds a text, a top-k report."""
    return api.module_search(catalogue(s, d), " Store ")


@query("v15_lookup", f"with {_CAT}, c as (select m, regexp_extract(m, '([^/#.:@]+)$', 1) as n, {_PATH_OF.format('m')} as p from called) select repository_id, commit_sha, moniker, case when path = p then 0 when ends_with(path, p) and p <> '' then 1 when contains(path, p) and p <> '' then 2 else 3 end as tier from sym, c where name = n")
def v15_lookup(s: SparkSession, d: str) -> DataFrame:
    """Symbols of a name, those of the asking file first."""
    import re

    f = catalogue(s, d)
    top = _most(f, "CALLS", "target")
    m = re.match(r"^\w+:[^:]*:([^#]*)", top)
    return api.symbol_lookup(f, re.search(r"([^/#.:@]+)$", top).group(1), m.group(1) if m else "").select("repository_id", "commit_sha", "moniker", "tier")


def _parts(s: SparkSession, d: str) -> api.Facts:
    """Parts as symbols: functions, methods and classes by size, under their brand."""
    p = table(s, d, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("function", "method", "class")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    symbols = p.select(F.lit("r").alias("repository_id"), F.lit("c").alias("commit_sha"), F.col("p_partkey").cast("string").alias("moniker"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified"), kind.alias("kind"), F.concat(F.lit("src/"), "p_brand", F.lit(".py")).alias("path"), F.col("p_size").alias("start"), F.lit(10).alias("end"), F.col("p_brand").alias("parent"))
    relations = p.select(F.lit("r").alias("repository_id"), F.lit("c").alias("commit_sha"), F.col("p_partkey").cast("string").alias("source"), (F.col("p_partkey") * 7 % 2600).cast("string").alias("target"), F.when(F.col("p_partkey") % 4 == 0, "INHERITS_FROM").otherwise("CALLS").alias("kind"), F.lit("x").alias("path"), F.lit(0).alias("line"))
    return api.Facts(symbols, relations)


_PART = "ps as (select p_partkey::varchar as moniker, p_name as name, p_type as qualified, ['function','method','class'][(p_partkey % 3 + 1)::int] as kind, 'src/' || p_brand || '.py' as path, p_size as start, 10 as fin, p_brand as parent from part), pr as (select p_partkey::varchar as source, (p_partkey * 7 % 2600)::varchar as target, case when p_partkey % 4 = 0 then 'INHERITS_FROM' else 'CALLS' end as kind from part)"


@query("v16_functions", f"with {_PART} select moniker, name, kind from ps where kind in ('function', 'method') and (contains(lower(name), 're') or contains(lower(qualified), 're') or contains(moniker, 're')) order by path, start, moniker limit 1000")
def v16_functions(s: SparkSession, d: str) -> DataFrame:
    """Functions and methods by a part of their name, a top-k report."""
    return api.function_search(_parts(s, d), "RE", 1000).select("moniker", "name", "kind")


@query("v15_same_name", f"with {_PART} select moniker, path from ps where name = (select name from ps where moniker = '1')")
def v15_same_name(s: SparkSession, d: str) -> DataFrame:
    """All definitions of one name."""
    f = _parts(s, d)
    return api.same_name_symbols(f, f.s.where("moniker = '1'").first()["name"]).select("moniker", "path")


@query("p20_structures", f"with {_PART} select source || ' -> ' || target as moniker, kind as name from pr where kind = 'INHERITS_FROM' union all select moniker, name from ps where kind = 'class' and contains(lower(name), 'a')")
def p20_structures(s: SparkSession, d: str) -> DataFrame:
    """P20: inheritance pairs, and classes by name."""
    f = _parts(s, d)
    return api.structural_match(f, "inheritance").unionByName(api.structural_match(f, "class", "A")).select("moniker", "name")


@query("p21_consistency", f"with {_PART} select distinct 'unknown_target' as problem, target as subject from pr where target not in (select moniker from ps) union all select 'span', moniker from ps where fin < start")
def p21_consistency(s: SparkSession, d: str) -> DataFrame:
    """Relations to unknown symbols, spans the wrong way and repeated symbols."""
    return api.consistency(_parts(s, d))


@query("j25_cross_references", f"with {_CAT} select r.repository_id, r.commit_sha, r.source, r.target, r.kind from rel r join sym a on a.repository_id = r.repository_id and a.commit_sha = r.commit_sha and a.moniker = r.source join sym b on b.repository_id = r.repository_id and b.commit_sha = r.commit_sha and b.moniker = r.target where contains(a.name, 'Store') or contains(b.name, 'Store')")
def j25_cross_references(s: SparkSession, d: str) -> DataFrame:
    """Relations of which either end's name holds a text."""
    return api.cross_references(catalogue(s, d), "Store").select("repository_id", "commit_sha", "source", "target", "kind")


@query("j12_lookup", f"with {_PART}, w as (select moniker as wanted from ps where moniker in ('1', '2', '3') union select name from ps union select qualified from ps union select 'nothing'), one as (select name, min(moniker) as id from ps group by 1 having count(*) = 1), h as (select wanted, moniker as id, 1 as tier from w join ps on moniker = wanted union all select wanted, moniker, 2 from w join ps on qualified = wanted union all select wanted, id, 3 from w join one on name = wanted), b as (select wanted, min(tier) as tier from h group by 1) select w.wanted, h.id, h.tier from w left join (select h.* from h join b using (wanted, tier)) h using (wanted)")
def j12_lookup(s: SparkSession, d: str) -> DataFrame:
    """Names to nodes by id, qualified name or the only bare name."""
    n = _parts(s, d).s.select(F.col("moniker").alias("id"), "qualified", "name")
    wanted = n.where("id in ('1', '2', '3')").select(F.col("id").alias("wanted")).union(n.select("name")).union(n.select("qualified")).union(s.createDataFrame([("nothing",)], "wanted string")).distinct()
    return resolve.lookup_nodes(wanted, n)


@query("p14_filter", f"with {_PART} select moniker from ps where kind in ('class', 'method') and parent in ('Brand#11', 'Brand#12', 'Brand#21')")
def p14_filter(s: SparkSession, d: str) -> DataFrame:
    """Symbols by kind, visibility and extension; the filters reach the scan."""
    rows = _parts(s, d).s.withColumn("visibility", F.col("parent"))
    return context.kind_filter(rows, ["class", "method"], ["Brand#11", "Brand#12", "Brand#21"], [".py"]).select("moniker")


@query("v17_api_search", f"with {_PART} select moniker, path, name from ps where contains(lower(name), 'an') and kind = 'class' order by path, name, moniker limit 50")
def v17_api_search(s: SparkSession, d: str) -> DataFrame:
    """Public symbols by a part of their name and kind, a top-k report."""
    surface = _parts(s, d).s.orderBy("path", "name", "moniker")
    return context.api_search(surface, "AN", 50, kind="class").select("moniker", "path", "name")


# ---------------------------------------------------------------- graphs

@query("q07_descendants", f"{_WALK} select g, start, node, depth from b where depth > 0")
def q07_descendants(s: SparkSession, d: str) -> DataFrame:
    """What each node reaches."""
    e = dependencies(s, d)
    return api.graph_question("descendants", e)


@query("q07_impact", f"{_WALK} select g, node as start, start as node, depth from b where depth > 0")
def q07_impact(s: SparkSession, d: str) -> DataFrame:
    """What reaches each node."""
    e = dependencies(s, d)
    return api.graph_question("impact", e)


@query("q07_paths", f"{_WALK}, p as (select g, start, start as node, 0 as depth, [start] as path from every union all select p.g, p.start, e.dst, p.depth + 1, min(list_append(p.path, e.dst)) from p join e on e.g = p.g and e.src = p.node join b on b.g = p.g and b.start = p.start and b.node = e.dst and b.depth = p.depth + 1 group by all) select p.g, p.start, p.node, p.depth, array_to_string(p.path, ' > ') as path from p join si on si.g = p.g and si.start = p.node")
def q07_paths(s: SparkSession, d: str) -> DataFrame:
    """The smallest shortest path from each node to the most used node of its graph."""
    e = dependencies(s, d)
    target = graph.small_starts(e, "dst").withColumnRenamed("start", "target")
    return api.graph_question("shortest_path", e, starts=every_node(e), targets=target).select("g", "start", "node", "depth", F.array_join("path", " > ").alias("path"))


@query("q07_entries", f"with {E_SQL} select g, node from nodes n where not exists (select 1 from e where e.g = n.g and e.dst = n.node)")
def q07_entries(s: SparkSession, d: str) -> DataFrame:
    """Nodes nobody depends on."""
    return api.graph_question("entries", dependencies(s, d))


@query("u15_unreachable", f"with recursive {E_SQL}, r as (select g, start as node from so union select r.g, e.dst from r join e on e.g = r.g and e.src = r.node) select g, node from nodes except select g, node from r")
def u15_unreachable(s: SparkSession, d: str) -> DataFrame:
    """The complement of what the node with the most dependencies of each graph reaches."""
    e = dependencies(s, d)
    return graph.unreachable(e, graph.small_starts(e).withColumnRenamed("start", "node"))


@query("u05_canonical_cycles", f"with {E_SQL} select distinct a.g, least(a.src, a.dst) || ' > ' || greatest(a.src, a.dst) as cycle from e a join e b on a.g = b.g and a.dst = b.src and a.src = b.dst where a.src <> a.dst")
def u05_canonical_cycles(s: SparkSession, d: str) -> DataFrame:
    """Cycles of two nodes, found from either end, in one form."""
    e = dependencies(s, d)
    back = graph.reverse(e)
    both = e.join(back, ["g", "src", "dst"], "left_semi").where("src <> dst")
    return both.select("g", F.array_join(graph.canonical_cycle(F.array("src", "dst")), " > ").alias("cycle")).distinct()


_BOUNDED = "{W}, p as (select g, start, start as node, 0 as depth, [start] as path from every union all select p.g, p.start, {E}, p.depth + 1, min(list_append(p.path, {E})) from p join e on e.g = p.g and {F} = p.node join q on q.g = p.g and q.start = p.start and q.node = {E} and q.depth = p.depth + 1 where p.depth < {N} group by all)"
_FORWARD = _BOUNDED.format(W=f"{_WALK}, q as (select * from b)", E="e.dst", F="e.src", N=4)
_BACKWARD = _BOUNDED.format(W=f"{_WALK}, q as (select g, node as start, start as node, depth from b)", E="e.src", F="e.dst", N=3)


@query("g12_callers", f"{_BACKWARD} select g, start, node, depth, array_to_string(path, ' > ') as path, case depth when 1 then 'HIGH' else 'MEDIUM' end as tier from p where depth > 0")
def g12_callers(s: SparkSession, d: str) -> DataFrame:
    """Callers of each node within three steps, with path and tier."""
    e = dependencies(s, d)
    return calls.caller_closure(e, every_node(e)).select("g", "start", "node", "depth", F.array_join("path", " > ").alias("path"), "tier")


@query("g27_sample_paths", f"{_FORWARD} select g, start, node, depth, array_to_string(path, ' > ') as path from (select *, row_number() over (partition by g, start order by depth, path) as r from p where depth > 0) where r <= 5")
def g27_sample_paths(s: SparkSession, d: str) -> DataFrame:
    """Up to five shortest dependency paths of each node, a sampling operator."""
    e = dependencies(s, d)
    return calls.sample_paths(e, every_node(e)).select("g", "start", "node", "depth", F.array_join("path", " > ").alias("path"))


_FILES = "f as (select distinct repository_id as g, path from ria_file_unit where path is not null)"
_TREE = f"""{_FILES}, c as (select g, path, unnest(range(1, len(string_split(path, '/')))) as i from f), dirs as (select distinct g, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir from c),
par as (select g, 'directory:' || dir as dst, regexp_extract(dir, '^(.*)/[^/]*$', 1) as up from dirs union all select g, 'file:' || path, regexp_extract(path, '^(.*)/[^/]*$', 1) from f),
te as (select g, case when up = '' then 'repository:' || g else 'directory:' || up end as src, dst from par)"""


def _file_tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return knowledge.knowledge_graph({"files": table(s, d, "ria_file_unit").select(F.col("repository_id").alias("g"), "path")}, ["directories"])


@query("j24_tree_edges", f"with {_TREE} select g, src, dst, 'CONTAINS' as kind from te")
def j24_tree_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges of a knowledge graph of one provider."""
    return _file_tree(s, d)[1]


@query("j33_tree_nodes", f"with {_TREE} select distinct g, 'repository:' || g as id, 'repository' as kind, g as name from f union all select g, 'directory:' || dir, 'directory', regexp_extract(dir, '[^/]*$') from dirs union all select g, 'file:' || path, 'file', regexp_extract(path, '[^/]*$') from f")
def j33_tree_nodes(s: SparkSession, d: str) -> DataFrame:
    """Its nodes."""
    return _file_tree(s, d)[0]


@query("g23_triples", f"with {_TREE}, n as (select 'repository:' || g as id, g, g as name from (select distinct g from f) union all select 'directory:' || dir, g, regexp_extract(dir, '[^/]*$') from dirs union all select 'file:' || path, g, regexp_extract(path, '[^/]*$') from f) select te.g, a.name as source, 'CONTAINS' as kind, b.name as target from te join n a on a.g = te.g and a.id = te.src join n b on b.g = te.g and b.id = te.dst")
def g23_triples(s: SparkSession, d: str) -> DataFrame:
    """Edges of the graph by names."""
    return knowledge.triples(*_file_tree(s, d))


@query("g25_ripple", f"with {_TREE}, ch as (select distinct g, 'directory:' || dir as id from dirs where length(dir) % 2 = 0), x as (select te.g, dst as other from te join ch on ch.g = te.g and ch.id = te.src union all select te.g, src from te join ch on ch.g = te.g and ch.id = te.dst) select g, 'CONTAINS' as kind, count(*) as edges, count(distinct other) as nodes from x group by g")
def g25_ripple(s: SparkSession, d: str) -> DataFrame:
    """Edges that touch changed nodes, and the nodes at their other ends."""
    nodes, edges = _file_tree(s, d)
    changed = nodes.where("kind = 'directory' and length(id) % 2 = 0")
    return knowledge.ripple(edges, changed)


@query("u06_merged_graph", f"with {_TREE}, old_ as (select g || id as id, id as path from (select g, 'directory:' || dir as id from dirs)), nw as (select 'new' || id as id, path from old_ where length(path) % 5 = 0), kept as (select * from old_ where length(path) % 5 <> 0), allof as (select * from kept union select * from nw) select (select count(*) from allof) as nodes, (select count(distinct id) from allof) as ids, (select count(*) from (select distinct g || src as s, g || dst as t from te) where s in (select id from allof) and t in (select id from allof)) as edges")
def u06_merged_graph(s: SparkSession, d: str) -> DataFrame:
    """A graph after an update: touched paths leave, new nodes come, edges stay where both ends do."""
    nodes, edges = _file_tree(s, d)
    nodes = nodes.where("kind = 'directory'").select(F.concat("g", "id").alias("id"), F.col("id").alias("path"))
    edges = edges.select(F.concat("g", "src").alias("src"), F.concat("g", "dst").alias("dst"))
    touched = nodes.where("length(path) % 5 = 0")
    new = touched.select(F.concat(F.lit("new"), "id").alias("id"), "path")
    n, e = diff.merge_delta(nodes, edges, touched, new, edges.where("false"))
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids")).join(e.agg(F.count(F.lit(1)).alias("edges")))


_CALLS = f"{_CAT}, k as (select distinct repository_id || '@' || commit_sha as g, path, source as caller, target as callee, regexp_extract(target, '([^/#.:@]+)$', 1) as name from rel where kind = 'CALLS')"


def _calls(s: SparkSession, d: str) -> DataFrame:
    r = catalogue(s, d).r.where("kind = 'CALLS'")
    return r.select(F.concat_ws("@", "repository_id", "commit_sha").alias("g"), "path", F.col("source").alias("caller"), F.col("target").alias("callee"), F.regexp_extract("target", r"([^/#.:@]+)$", 1).alias("name")).distinct()


@query("t06_partial_calls", f"with {_CALLS} select * from k")
def t06_partial_calls(s: SparkSession, d: str) -> DataFrame:
    """A partial build over stale rows of changed files and renamed callees equals the full one."""
    now = materialize(_calls(s, d), "calls")
    stale = now.where("length(path) % 3 = 0").withColumn("callee", F.lit("gone")).unionByName(now.where("length(path) % 3 <> 0 and name not like '%Store%'")).unionByName(now.where("length(path) % 3 <> 0 and name like '%Store%'").withColumn("caller", F.lit("stale")))
    return calls.partial_call_graph(stale, now, now.where("length(path) % 3 = 0").select("g", "path").distinct(), now.where("name like '%Store%'").select("g", "name").distinct())


@query("t07_partial_index", f"with {_CALLS} select distinct name as term, path from k")
def t07_partial_index(s: SparkSession, d: str) -> DataFrame:
    """An inverted index after a third of its files changed equals a new one."""
    now = materialize(_calls(s, d).select(F.col("name").alias("term"), "path").distinct(), "terms")
    changed = now.where("length(path) % 3 = 0")
    return calls.update_index(now.where("length(path) % 3 <> 0").unionByName(changed.withColumn("term", F.lit("stale"))), changed, changed)


# ---------------------------------------------------------------- paths, texts and spans

@query("f04_tests", f"with {_P} select path, category = 'test' as test, category = 'generated' as generated from (select path, {_CATEGORY} as category from x)")
def f04_tests(s: SparkSession, d: str) -> DataFrame:
    """Test and generated paths."""
    u = table(s, d, "ria_file_unit").where("path is not null").select("path").distinct()
    return u.select("path", paths.is_test_path(F.col("path")).alias("test"), paths.is_generated_path(F.col("path")).alias("generated"))


@query("p09_excluded", f"with {_P} select path, not starts_with(path, 'src/') and (regexp_matches(path, '{context.EXCLUDED}') or category in ('generated', 'test')) as excluded from (select path, {_CATEGORY} as category from x)")
def p09_excluded(s: SparkSession, d: str) -> DataFrame:
    """Paths that retrieval leaves out unless they are named."""
    u = table(s, d, "ria_file_unit").where("path is not null").select("path").distinct()
    return u.select("path", context.is_excluded(F.col("path"), F.col("path").startswith("src/")).alias("excluded"))


@query("p13_entry_files", "select distinct path, lower(regexp_extract(path, '[^/]*$')) in ('main.py','app.py','server.py','index.js','index.ts','main.ts','main.tsx','manage.py','wsgi.py','asgi.py','cli.py') or starts_with(path, 'app/') or starts_with(path, 'pages/') or (len(string_split(path, '/')) <= 3 and language = 'python') as entry from (select path, min(language) as language from ria_file_unit where path is not null group by 1)")
def p13_entry_files(s: SparkSession, d: str) -> DataFrame:
    """Entry files by name, folder or a framework import near the top (here every Python file imports one)."""
    u = table(s, d, "ria_file_unit").where("path is not null").groupBy("path").agg(F.min("language").alias("language"))
    return u.select("path", context.is_entry_file(F.col("path"), F.when(F.col("language") == "python", F.array(F.lit("flask"))).otherwise(F.array(F.lit("none")))).alias("entry"))


@query("f08_module_paths", r"select distinct path, replace(regexp_replace(replace(regexp_replace(path, '\.[^./]+$', ''), '/', '.'), '\.__init__$', ''), '.', '/') as back from ria_file_unit where path is not null")
def f08_module_paths(s: SparkSession, d: str) -> DataFrame:
    """a path as a module and as a path again."""
    u = table(s, d, "ria_file_unit").where("path is not null").select("path").distinct()
    return u.select("path", paths.module_path(paths.module_of(F.col("path"))).alias("back"))


@query("f11_literals", "select task_id, replace(replace(change_description, 'change', '***'), 'file', '***') as clean from impact_tasks")
def f11_literals(s: SparkSession, d: str) -> DataFrame:
    """known secrets replaced, longest first."""
    return table(s, d, "impact_tasks").select("task_id", text.redacted_literals(F.col("change_description"), ["file", "change", ""]).alias("clean"))


@query("f13_declared", r"with s as (select repository_id, content_hash, replace(content, 'import ', '__all__ = [''') as c from source_files where content is not null) select repository_id, content_hash, list_sort(list_distinct(regexp_extract_all(regexp_extract(c, '__all__\s*=\s*[\[(]([^\])]*)[\])]', 1), '[''\x22]([A-Za-z0-9_]+)[''\x22]', 1)))::varchar as names from s where regexp_matches(c, '__all__\s*=\s*[\[(]')")
def f13_declared(s: SparkSession, d: str) -> DataFrame:
    """names in lists of public names (made here from import lines)."""
    t = table(s, d, "source_files").where("content is not null").withColumn("c", F.replace("content", F.lit("import "), F.lit("__all__ = ['")))
    names = F.array_sort(text.declared_all(F.col("c")))
    return t.select("repository_id", "content_hash", F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("names")).where("names is not null")


@query("f14_efforts", "select p_size, case when p_size < 2 then 'under 2 hours' when p_size < 8 then 'half a day' when p_size < 24 then '1-3 days' when p_size < 80 then '1-2 weeks' else 'over 2 weeks' end as label from (select distinct p_size from part)")
def f14_efforts(s: SparkSession, d: str) -> DataFrame:
    """efforts in words."""
    return table(s, d, "part").select("p_size").distinct().select("p_size", text.hours_label(F.col("p_size")).alias("label"))


@query("f15_refs", "select repository_id, default_branch as branch from ria_repository")
def f15_refs(s: SparkSession, d: str) -> DataFrame:
    """branches without their prefix."""
    ref = F.when(F.length("repository_id") % 2 == 0, F.concat(F.lit("refs/heads/"), "default_branch")).otherwise(F.concat(F.lit(" refs/remotes/origin/"), "default_branch", F.lit(" ")))
    return table(s, d, "ria_repository").select("repository_id", text.ref_name(ref).alias("branch"))


@query("f16_spans", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey <= l_suppkey and l_suppkey + 10 <= l_partkey + 40) as holds, (l_partkey < l_suppkey + 10 and l_suppkey < l_partkey + 40) as meets from lineitem")
def f16_spans(s: SparkSession, d: str) -> DataFrame:
    """F16: whether spans hold or overlap one another."""
    a, b = (F.col("l_partkey"), F.col("l_partkey") + 40), (F.col("l_suppkey"), F.col("l_suppkey") + 10)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.span_contains(*a, *b).alias("holds"), text.span_overlaps(*a, *b).alias("meets"))


@query("p07_signatures", "select p_partkey, len(list_filter(string_split('self,' || replace(p_type, ' ', ','), ','), lambda x: x <> '' and x not in ('self', 'cls'))) as params, regexp_matches(p_name, '\\basync\\b') as is_async from part")
def p07_signatures(s: SparkSession, d: str) -> DataFrame:
    """Parameters without the receiver, and whether a definition is asynchronous."""
    out = context.signature(F.concat(F.lit("self,"), F.translate("p_type", " ", ",")), F.col("p_name"))
    return table(s, d, "part").select("p_partkey", out["param_count"].cast("bigint").alias("params"), out["is_async"].alias("is_async"))


# ---------------------------------------------------------------- scores

@query("a13_quality", "select p_partkey, (greatest(0, least(100, p_size::int)) + greatest(0, least(100, trunc(p_retailprice / 10)::int)) + greatest(0, least(100, 150 - p_size::int))) / 3 as quality from part")
def a13_quality(s: SparkSession, d: str) -> DataFrame:
    """The mean of subscores cut to whole numbers in 0 to 100."""
    return table(s, d, "part").select("p_partkey", scoring.quality([F.col("p_size"), F.col("p_retailprice") / 10, 150 - F.col("p_size")]).alias("quality"))


@query("a17_category_scores", f"with {_F} select category, greatest(0, round(100 - sum((map {{'critical': 20.0, 'high': 10.0, 'medium': 5.0, 'low': 2.0, 'info': 0.5}}[severity])::double * confidence), 1)) as score from f group by 1")
def a17_category_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of categories by the cost of their findings."""
    return scoring.category_scores(_findings(s, d))


@query("a24_macro", "with c as (select o_orderstatus as g, count(*) filter (o_orderpriority = '1-URGENT') as fp, avg(o_totalprice) / 500000 as precision, avg(o_custkey) / 2000 as recall from orders group by 1) select avg(precision) as precision, avg(recall) as recall, avg(least(precision, recall)) as f1, sum(fp)::bigint as fp from c")
def a24_macro(s: SparkSession, d: str) -> DataFrame:
    """Unweighted means over groups and all false positives."""
    m = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.expr("o_orderpriority = '1-URGENT'")).alias("fp"), (F.avg("o_totalprice") / 500000).alias("precision"), (F.avg("o_custkey") / 2000).alias("recall"))
    return scoring.macro_average(m.withColumn("f1", F.least("precision", "recall")))


@query("a32_throughput", "select event_type as stage, count(*) as files, round(sum(abs(value)), 4) as seconds, round(count(*) / sum(abs(value)), 6) as files_per_second from events group by 1")
def a32_throughput(s: SparkSession, d: str) -> DataFrame:
    """Files a second of each stage."""
    out = calls.throughput(table(s, d, "events").select(F.col("event_type").alias("stage"), F.lit(1).alias("files"), F.abs("value").alias("seconds")))
    return out.select("stage", "files", F.round("seconds", 4).alias("seconds"), F.round("files_per_second", 6).alias("files_per_second"))


_CHANGES = "c as (select repository_id, sha, coalesce(files_changed, 0) as f, coalesce(insertions, 0) as i, coalesce(deletions, 0) as x from ria_commit)"


def _commits(s: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0))
    return table(s, d, "ria_commit").select("repository_id", "sha", z("files_changed").alias("f"), z("insertions").alias("i"), z("deletions").alias("x"))


@query("r06_risks", f"with {_CHANGES}, t as (select repository_id, sha, least(100, least(15, greatest(3, f)) + least(10, greatest(2, i // 10)) + least((f % 3) * 10, 20) + case when x % 4 > 0 then 15 else 0 end + least((i % 3) * 5, 10) + least(trunc((f / 50.0) * 15)::int, 15) + least((x % 7) * 2, 10) + case when x > 0 then 5 else 0 end) as score from c) select repository_id, sha, score::bigint as score, case when score <= 25 then 'low' when score <= 50 then 'medium' when score <= 75 then 'high' else 'critical' end as level from t")
def r06_risks(s: SparkSession, d: str) -> DataFrame:
    """The risk of every commit from eight factors."""
    c = _commits(s, d)
    f = {"files": F.col("f"), "symbols": F.expr("i div 10"), "core": F.col("f") % 3, "entry": F.col("x") % 4, "coupling": F.col("i") % 3, "ratio": F.col("f") / 50.0, "depth": F.col("x") % 7, "removed": F.col("x")}
    score, level = scoring.pr_risk(f)
    return c.select("repository_id", "sha", score.cast("bigint").alias("score"), level.alias("level"))


@query("r08_drift", f"with {_CHANGES} select repository_id, sha, (case when f % 2 > 0 then 45 else 0 end + case when i % 3 > 0 then 15 else 0 end + case when x % 2 > 0 then 10 else 0 end + case when f >= 5 then 15 else 0 end + case when i > 50 then 15 else 0 end + case when f % 4 > 0 then 10 else 0 end + case when x > 0 then 5 else 0 end)::bigint as score from c")
def r08_drift(s: SparkSession, d: str) -> DataFrame:
    """The degradation score of every commit."""
    score = scoring.drift_score(F.col("f") % 2, F.col("i") % 3, F.col("x") % 2, F.col("f"), F.when(F.col("i") > 50, 1).otherwise(0), F.col("f") % 4, F.col("x"))
    return _commits(s, d).select("repository_id", "sha", score.cast("bigint").alias("score"))


@query("r10_rescored", f"with {_F} select id, least(1.0, greatest(0.0, confidence + least(0.05 * (id % 5), 0.15) - case when id % 3 = 0 and o_custkey > 20 then 0.10 else 0 end))::double as confidence from f")
def r10_rescored(s: SparkSession, d: str) -> DataFrame:
    """findings' confidence by evidence and entities."""
    return _findings(s, d).select("id", scoring.rescored_confidence(F.col("confidence"), F.col("id") % 5, F.col("id") % 3, F.col("o_custkey")).alias("confidence"))


_KINDS = [*scoring.EVIDENCE, "OTHER"]
_EVIDENCE = "ev as (select o_custkey, o_orderkey, o_orderstatus, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][(o_orderkey % 8 + 1)::int] as kind, [1.00, 0.95, 0.85, 0.80, 0.75, 0.50, 0.25, 0.25][(o_orderkey % 8 + 1)::int]::double as w from orders)"


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 8 + 1).cast("int")))


@query("r20_reasoning", f"with {_EVIDENCE} select o_custkey as claim, greatest(0, round(100 * avg(w) - 25 * count(*) filter (o_orderstatus = 'P'), 2)) as confidence from ev group by 1")
def r20_reasoning(s: SparkSession, d: str) -> DataFrame:
    """Confidence of claims by the weight of their evidence, less for contradictions."""
    return knowledge.reasoning(_evidence(s, d).select(F.col("o_custkey").alias("claim"), "kind", (F.col("o_orderstatus") == "P").alias("contradicts")))


@query("r22_tiers", f"with {_EVIDENCE}, t as (select o_orderstatus as g, o_custkey as file, max(w) as score from ev group by all) select *, case when score >= 0.85 then 'HIGH' when score >= 0.5 then 'MEDIUM' else 'LOW' end as tier from t")
def r22_tiers(s: SparkSession, d: str) -> DataFrame:
    """Affected files by their best evidence."""
    return knowledge.impact_tiers(_evidence(s, d).select(F.col("o_orderstatus").alias("g"), F.col("o_custkey").alias("file"), "kind"))


@query("a31_operating_points", f"with {_EVIDENCE}, t as (select o_orderstatus as g, o_custkey as file, max(w) as score from ev group by all), m as (select g, unnest(case when score >= 0.85 then ['SAFE', 'BALANCED', 'EXPLORATORY'] when score >= 0.5 then ['BALANCED', 'EXPLORATORY'] else ['EXPLORATORY'] end) as mode from t) select g, mode, count(*) as files from m group by all")
def a31_operating_points(s: SparkSession, d: str) -> DataFrame:
    """How many files each output mode lists."""
    return knowledge.operating_points(r22_tiers(s, d))


@query("r24_gaps", "with l as (select distinct o_custkey as learner from orders), c as (select distinct o_orderpriority as concept from orders), done as (select distinct o_custkey as learner, o_orderpriority as concept from orders), sc as (select o_custkey as learner, o_orderpriority as concept, min(o_totalprice / 1000) as score from orders group by all) select learner, concept, 'missing' as reason from (select learner, concept from l, c except select * from done) union all select learner, concept, 'weak' from sc where score < 60")
def r24_gaps(s: SparkSession, d: str) -> DataFrame:
    """Concepts that learners miss or are weak in."""
    o = table(s, d, "orders")
    steps = o.select(F.col("o_custkey").alias("learner"), F.concat(F.lit("done: "), "o_orderpriority").alias("title"))
    scores = o.groupBy(F.col("o_custkey").alias("learner"), F.col("o_orderpriority").alias("concept")).agg((F.min("o_totalprice") / 1000).alias("score"))
    return knowledge.learning_gaps(steps, o.select(F.col("o_orderpriority").alias("concept")), scores)


# ---------------------------------------------------------------- retrieval and texts of reports

@query("v04_shadow", "with a as (select distinct p_brand as path from part where p_size < 10), b as (select distinct p_brand as path from part where p_size > 48) select 'first' as side, path from (select * from a except select * from b) union all select 'second', path from (select * from b except select * from a)")
def v04_shadow(s: SparkSession, d: str) -> DataFrame:
    """Paths that only one of two retrievals returned."""
    p = table(s, d, "part").withColumn("path", F.col("p_brand"))
    return context.same_results(p.where("p_size < 10"), p.where("p_size > 48"))


@query("v27_bracket_citations", "with a as (select o_orderkey as answer_id, o_orderpriority as p, o_orderstatus as st from orders) select answer_id, unnest([p, st, 'none']) as ref_id, unnest([true, false, false]) as known from a")
def v27_bracket_citations(s: SparkSession, d: str) -> DataFrame:
    """Bracketed citations of answers, known or not."""
    o = table(s, d, "orders").withColumnRenamed("o_orderkey", "answer_id")
    answers = o.select("answer_id", F.concat(F.lit("see ["), F.translate("o_orderpriority", " ", "_"), F.lit("], ["), "o_orderstatus", F.lit("] and [none], again [none]")).alias("text"))
    return context.bracket_citations(answers, o.select("answer_id", F.translate("o_orderpriority", " ", "_").alias("ref_id"))).withColumn("ref_id", F.translate("ref_id", "_", " "))


@query("w08_references", "select o_custkey as id, max(case o_orderstatus when 'F' then 10 when 'O' then 8 when 'P' then 5 else 2 end) + 3 * max((o_totalprice > 200000)::int) + 5 * max((o_orderpriority = '1-URGENT')::int) as score from orders group by 1")
def w08_references(s: SparkSession, d: str) -> DataFrame:
    """References merged and weighted by type, hotspot and name."""
    kind = F.when(F.col("o_orderstatus") == "F", "file").when(F.col("o_orderstatus") == "O", "symbol").when(F.col("o_orderstatus") == "P", "commit").otherwise("other")
    return context.merged_references(table(s, d, "orders").select(F.col("o_custkey").alias("id"), kind.alias("type"), (F.col("o_totalprice") > 200000).alias("hotspot"), (F.col("o_orderpriority") == "1-URGENT").alias("named")))


@query("v08_gate", "with f as (select distinct path from ria_file_unit where path is not null), q as (select lower('what breaks in ' || (select min(path) from f) || ' and ' || (select regexp_extract(max(path), '[^/]*$') from f)) as q), h as (select path, 1 as tier, 100 as confidence from f, q where contains(q, lower(path)) union all select path, 2, 98 from f, q where length(regexp_extract(path, '[^/]*$')) > 4 and contains(q, lower(regexp_extract(path, '[^/]*$')))) select path, min(tier) as tier, max(confidence) as confidence from h group by 1")
def v08_gate(s: SparkSession, d: str) -> DataFrame:
    """Files that a question names outright."""
    f = table(s, d, "ria_file_unit").where("path is not null").select("path").distinct()
    ends = f.agg(F.min("path").alias("a"), F.max("path").alias("z")).first()
    symbols = f.where("false").withColumn("name", F.lit(""))
    return context.gate(f"What breaks in {ends['a']} and {ends['z'].rpartition('/')[2]}", f, symbols)


@query("x08_last_day", "select event_id, user_id from (select *, max(ts) over (partition by user_id) as last from events) where ts >= last - interval 1 day")
def x08_last_day(s: SparkSession, d: str) -> DataFrame:
    """Turns of the last day of each conversation."""
    return context.last_day(table(s, d, "events").withColumn("conversation", F.col("user_id"))).select("event_id", "user_id")


@query("r04_steps", "with a as (select o_custkey as id, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'F')) as seeds, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'P')) as tests from orders group by 1), b as (select id, list_filter([case when len(seeds) > 0 then 'Change: ' || array_to_string(seeds[1:2], ', ') end, case when len(tests) > 0 then 'Run tests: ' || array_to_string(tests[1:3], ', ') end], lambda x: x is not null) as st from a), c as (select id, case when len(st) > 0 then st else ['Find the affected files', 'Change them', 'Run the tests'] end as st from b) select id, array_to_string(list_transform(st, lambda x, i: i || '. ' || x), ' | ') as steps from c")
def r04_steps(s: SparkSession, d: str) -> DataFrame:
    """Numbered steps for each change."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("seeds"), F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("tests"))
    none = F.array().cast("array<string>")
    return context.plan_steps(o.withColumns({c: none for c in ("direct", "callers", "routes")})).select("id", F.array_join("steps", " | ").alias("steps"))


@query("r28_summaries", f"with {E_SQL}, n as (select g, count(*) as nodes from nodes group by g), m as (select g, count(*) as edges from e group by g), u as (select repository_id || '@' || commit_sha as g, count(distinct path) as files from ria_file_unit where path is not null group by 1) select g, files, nodes, edges from u left join n using (g) left join m using (g)")
def r28_summaries(s: SparkSession, d: str) -> DataFrame:
    """One summary of files and graph for each commit."""
    u = table(s, d, "ria_file_unit").where("path is not null").select(F.concat_ws("@", "repository_id", "commit_sha").alias("g"), "path").distinct()
    return context.repository_summary(u, graph.statistics(dependencies(s, d))).select("g", "summary.files", "summary.nodes", "summary.edges")


@query("v19_novelty", None)
def v19_novelty(s: SparkSession, d: str) -> DataFrame:
    """Novelty of each task's description against the one before."""
    from pyspark.sql.window import Window

    t = table(s, d, "impact_tasks").select("task_id", F.col("change_description").alias("a"), F.lag("change_description").over(Window.partitionBy("repository").orderBy("task_id")).alias("b")).where("b is not null")
    return search.jaccard_novelty(t).select("task_id", "novelty")


# ---------------------------------------------------------------- sources and sinks

def _folder(s: SparkSession, label: str) -> str:
    return f"{shared_folder(s)}/{label}-{uuid.uuid4().hex}"


_UNITS = "u as (select distinct repository_id, commit_sha, path from ria_file_unit where repository_id is not null and commit_sha is not null and path is not null)"


def _units(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ria_file_unit").select("repository_id", "commit_sha", "path").dropna().distinct()


@query("k01_replaced_facts", f"with {_UNITS}, first_ as (select repository_id, min(commit_sha) as c from u group by 1) select repository_id, commit_sha, case when commit_sha = (select c from first_ f where f.repository_id = u.repository_id) then 'new/' || path else path end as path, length(path) as size from u")
def k01_replaced_facts(s: SparkSession, d: str) -> DataFrame:
    """A fact table of which one commit of each repository was written again."""
    u, folder = _units(s, d).withColumn("size", F.length("path")), _folder(s, "facts")
    source_files.write_facts(u, folder, ["repository_id", "commit_sha", "path"])
    first = u.groupBy("repository_id").agg(F.min("commit_sha").alias("commit_sha"))
    again = u.join(first, ["repository_id", "commit_sha"], "left_semi").withColumn("path", F.concat(F.lit("new/"), "path"))
    source_files.write_facts(again, folder, ["repository_id", "commit_sha", "path"])
    return source_files.read_facts(s, folder).select("repository_id", "commit_sha", "path", "size")


@query("k02_deleted_facts", f"with {_UNITS}, one as (select min(repository_id || '/' || commit_sha) as k from u) select repository_id, commit_sha, count(*) as files from u where repository_id || '/' || commit_sha <> (select k from one) group by all")
def k02_deleted_facts(s: SparkSession, d: str) -> DataFrame:
    """A fact table without one commit."""
    u, folder = _units(s, d), _folder(s, "facts")
    source_files.write_facts(u, folder, ["repository_id", "commit_sha", "path"])
    key = u.agg(F.min(F.concat_ws("/", "repository_id", "commit_sha"))).first()[0].split("/")
    source_files.delete_facts(s, folder, *key)
    return s.read.parquet(folder).groupBy("repository_id", "commit_sha").agg(F.count(F.lit(1)).alias("files"))


@query("s05_point_read", f"with {_UNITS}, k as (select min((repository_id, commit_sha, path)) as k from u) select repository_id, commit_sha, path, content_hash from ria_file_unit where (repository_id, commit_sha, path) = (select k from k)")
def s05_point_read(s: SparkSession, d: str) -> DataFrame:
    """One file at one commit."""
    u = table(s, d, "ria_file_unit")
    k = _units(s, d).agg(F.min(F.struct("repository_id", "commit_sha", "path")).alias("k")).first()["k"]
    return source_files.point_read(u, *k).select("repository_id", "commit_sha", "path", "content_hash")


@query("k05_published", "select repository_id, content_hash, length(content) as chars from source_files where content is not null and trim(content) <> '' and length(content_hash) % 2 = 0")
def k05_published(s: SparkSession, d: str) -> DataFrame:
    """Readers see the version that was published last."""
    b, folder = table(s, d, "source_files").select("repository_id", "content_hash", "content"), _folder(s, "published")
    source_files.publish_version(b.where("content_hash > 'f'"), folder, "1")
    source_files.publish_version(b.where("length(content_hash) % 2 = 0"), folder, "2")
    return source_files.read_published(s, folder).select("repository_id", "content_hash", F.length("content").alias("chars"))


@query("k06_without_files", f"with {_UNITS} select * from u where path not in (select path from u group by path having count(distinct repository_id || commit_sha) > 5)")
def k06_without_files(s: SparkSession, d: str) -> DataFrame:
    """Rows but those of given files."""
    u = _units(s, d)
    return source_files.without_files(u, u.groupBy("path").agg(F.countDistinct("repository_id", "commit_sha").alias("n")).where("n > 5"))


@query("t10_cache_misses", "select distinct chunk_hash from (select sha256(doc_id::varchar) as chunk_hash from documents union all select chunk_hash from embedding_cache) where chunk_hash not in (select chunk_hash from embedding_cache where model_name = 'lumen-code-small')")
def t10_cache_misses(s: SparkSession, d: str) -> DataFrame:
    """Keys that have to be computed."""
    cache = table(s, d, "embedding_cache").select("chunk_hash", "model_name")
    keys = table(s, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_hash")).unionByName(cache.select("chunk_hash"))
    return source_files.cache_misses(keys, cache.where("model_name = 'lumen-code-small'"))


@query("k04_documents", "select moniker as repository, repository_id as key, coalesce(status, '') as subkey, '{\"url\":\"' || origin_url || '\"}' as data from ria_repository")
def k04_documents(s: SparkSession, d: str) -> DataFrame:
    """JSON documents written and read again."""
    folder = _folder(s, "documents")
    r = table(s, d, "ria_repository")
    source_files.write_documents(r.select(F.col("moniker").alias("repository"), F.col("repository_id").alias("key"), F.coalesce("status", F.lit("")).alias("subkey"), F.to_json(F.struct(F.col("origin_url").alias("url"))).alias("data")), folder)
    return source_files.read_documents(s, folder)


@query("k09_report", "select '## ' || o_orderstatus as line from (select distinct o_orderstatus from orders) union all select '- **' || o_orderpriority || '**: ' || n from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all)")
def k09_report(s: SparkSession, d: str) -> DataFrame:
    """A report as Markdown lines."""
    return source_files.report_lines(table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("value")))


@query("k10_display", f"with {E_SQL}, n as (select g, count(*) as nodes from nodes group by g), m as (select g, count(*) as edges from e group by g) select g, nodes, edges from n join m using (g)")
def k10_display(s: SparkSession, d: str) -> DataFrame:
    """Each graph as one JSON document, read again and counted."""
    e = dependencies(s, d)
    out = source_files.subgraph_json(graph.nodes(e).select("g", F.col("node").alias("id"), F.lit("x").alias("category")), e)
    read = F.from_json("json", "nodes array<struct<id:string>>, edges array<struct<src:string>>")
    return out.select("g", F.size(read["nodes"]).cast("bigint").alias("nodes"), F.size(read["edges"]).cast("bigint").alias("edges"))


@query("s04_changed_files", "with t as (select distinct path from ria_file_unit where path is not null) select 'SRC' || r.path as path, t.path as tree_path from (select substr(path, 4) as path from t where length(path) % 3 = 0 and starts_with(path, 'src/')) r left join (select * from t where starts_with(path, 'src/')) t on lower(t.path) = lower('SRC' || r.path) union all select 'not/there.py', null")
def s04_changed_files(s: SparkSession, d: str) -> DataFrame:
    """Files of a request matched to a tree without case."""
    tree = table(s, d, "ria_file_unit").where("path is not null").select("path").distinct()
    request = tree.where("length(path) % 3 = 0 and path like 'src/%'").select(F.concat(F.lit("SRC"), F.expr("substr(path, 4)")).alias("path")).unionByName(s.createDataFrame([("not/there.py",)], "path string"))
    return source_files.changed_files(request, tree).select("path", "tree_path")


@query("s06_log", "select o_orderkey::varchar as hash, o_custkey::varchar as author, case l_linestatus when 'O' then 'added' else 'renamed' end as status, 'src/' || l_partkey || '.py' as path from lineitem join orders on o_orderkey = l_orderkey")
def s06_log(s: SparkSession, d: str) -> DataFrame:
    """Touches out of captured logs (one for each customer)."""
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    heads = o.select(F.col("o_custkey").alias("log"), (F.col("o_orderkey") * 100).alias("line_no"), F.concat_ws("|", F.lit("COMMIT"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("2024-01-02T03:04:05+00:00")).alias("line"))
    path = F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".py"))
    line = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("A\t"), path)).otherwise(F.concat(F.lit("R100\told.py\t"), path))
    rows = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("log"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), line.alias("line"))
    return history.parse_git_log(heads.unionByName(rows)).select("hash", "author", "status", "path")


@query("t01_plan", "select * from (values ('changed', 'calls', 'PARTIAL'), ('changed', 'report', 'PARTIAL'), ('changed', 'symbols', 'PARTIAL'), ('first', 'calls', 'FULL'), ('first', 'report', 'FULL'), ('first', 'symbols', 'FULL'), ('same', 'calls', 'SKIP'), ('same', 'report', 'SKIP'), ('same', 'symbols', 'SKIP')) t(run, stage, build)")
def t01_plan(s: SparkSession, d: str) -> DataFrame:
    """How each stage of a build is run, for three kinds of runs; the plan holds names, not data."""
    stages = {"report": ["calls", "symbols"], "calls": ["symbols"], "symbols": []}
    runs = {"first": (True, False, False, False), "changed": (True, True, True, True), "same": (False, True, True, True)}
    rows = [(run, stage, build) for run, given in runs.items() for stage, build in monitor.build_plan(stages, *given).items()]
    return s.createDataFrame(rows, "run string, stage string, build string")


# ---------------------------------------------------------------- further views

_KIND_OF = "split_part({}, ':', 1)"


@query("p17_projections", f"with {_CAT}, n as (select repository_id || '@' || commit_sha as g, s as src, t as dst, kind, {_KIND_OF.format('s')} as a, {_KIND_OF.format('t')} as b from live) "
    + " union all ".join(f"select '{name}' as projection, g, count(*) as edges from n where " + (f"kind in ({', '.join(repr(k) for k in ek)})" if ek else "true") + (f" and a in ({', '.join(repr(k) for k in nk)}) and b in ({', '.join(repr(k) for k in nk)})" if nk else "") + " group by g" for name, (nk, ek) in graph.PROJECTIONS.items()))
def p17_projections(s: SparkSession, d: str) -> DataFrame:
    """Edges of all nine named projections of each graph."""
    from functools import reduce

    from quarrylight.plans.graphs import kind_edges

    e = materialize(kind_edges(s, d).select("g", "src", "dst", "kind").distinct(), "kinds")
    n = graph.nodes(e).withColumn("kind", F.split("node", ":")[0])
    parts = [graph.project(e, n, name).groupBy("g").agg(F.count(F.lit(1)).alias("edges")).withColumn("projection", F.lit(name)) for name in graph.PROJECTIONS]
    return reduce(DataFrame.unionByName, parts).select("projection", "g", "edges")


@query("a08_call_stats", f"with {E_SQL}, d as (select g, node, sum(i) as fi from (select g, src as node, 0 as i from e union all select g, dst, 1 from e) group by all) select g, count(*) as nodes, (select count(*) from e where e.g = d.g) as edges, count(*) filter (fi = 0) as entries, (select count(*) from e where e.g = d.g and src = dst) as recursive from d group by g")
def a08_call_stats(s: SparkSession, d: str) -> DataFrame:
    """Nodes, edges, entries and self-recursive nodes of each call graph."""
    e = dependencies(s, d).select("g", F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(1).alias("line"), F.lit("HIGH").alias("confidence"))
    edges, nodes = calls.call_graph(e)
    n = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_entry").alias("entries"), F.count_if("is_recursive").alias("recursive"))
    return n.join(edges.groupBy("g").agg(F.count(F.lit(1)).alias("edges")), "g").select("g", "nodes", "edges", "entries", "recursive")


@query("j29_cyclic_pairs", f"with {E_SQL} select a.g, 'high' as severity, a.src || ' -> ' || a.dst as subject from e a join e b on a.g = b.g and a.src = b.dst and a.dst = b.src where a.src <> a.dst union all select g, 'medium', count(*) || ' dependencies' from e group by g having count(*) > 30")
def j29_cyclic_pairs(s: SparkSession, d: str) -> DataFrame:
    """Nodes that depend on each other, and graphs of more than thirty dependencies."""
    return knowledge.cyclic_pair_findings(dependencies(s, d)).select("g", "severity", "subject")


_MARKED = "case o_orderkey % 5 when 0 then 'x # Deprecated y' when 1 then 'DeprecationWarning @beta' when 2 then '@Experimental' when 3 then 'an alpha feature' else 'plain beta words' end"


@query("p06_lifecycle", f"select o_orderkey, case when regexp_matches(t, '{resolve.DEPRECATED}') then 'deprecated' when regexp_matches(t, '{resolve.EXPERIMENTAL}') then 'experimental' else 'stable' end as status from (select o_orderkey, {_MARKED} as t from orders)")
def p06_lifecycle(s: SparkSession, d: str) -> DataFrame:
    """The lifecycle of definitions by marks around them."""
    return table(s, d, "orders").select("o_orderkey", resolve.lifecycle(F.expr(_MARKED)).alias("status"))


@query("r23_concepts", "with c as (select o_custkey as concept, count(*) as files from orders group by 1), t as (select concept, least(100.0, round(files / 40.0 * 100, 1))::double as coverage from c), u as (select *, least(100, trunc(50 + 0.5 * coverage)::int) as importance from t) select concept, coverage, importance, case when coverage >= 50 then 4 when coverage >= 20 then 3 else 2 end as difficulty, case when importance >= 85 then 'essential' when importance >= 80 then 'important' when importance >= 75 then 'useful' else 'optional' end as label from u")
def r23_concepts(s: SparkSession, d: str) -> DataFrame:
    """Coverage, importance and difficulty of concepts."""
    c = table(s, d, "orders").groupBy(F.col("o_custkey").alias("concept")).agg(F.count(F.lit(1)).alias("files"))
    return c.select("concept", *[v.alias(k) for k, v in scoring.concept_scores(F.col("files"), F.lit(40)).items()])


@query("w05_context_ranks", "select doc_id as id, greatest(0, least(1, (doc_id % 10) / 10.0 + case when contains(text, 'scanner') then 0.2 else 0 end + case when contains(text, 'token') then 0.2 else 0 end + case when contains(source, 'issue') then 0.15 else 0 end))::double as score from documents where text is not null")
def w05_context_ranks(s: SparkSession, d: str) -> DataFrame:
    """Context items by target symbols and files."""
    docs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("path"), (F.col("doc_id") % 10 / 10.0).cast("double").alias("score"))
    return search.context_rank(docs, ["scanner", "token"], ["issue"])


@query("v29_issue_files", "with q as (select embedding::double[] as q from embeddings order by vec_id limit 1), n as (select label, greatest(0, round(1 - list_cosine_similarity(embedding::double[], q), 4))::double as distance from embeddings, q order by distance, vec_id limit 40) select 'l' || label as path, round(max(1 / (1 + distance)), 3) as score from n group by 1 order by score desc, path limit 10")
def v29_issue_files(s: SparkSession, d: str) -> DataFrame:
    """Files of the chunks nearest to an issue's vector, a top-k report."""
    v = table(s, d, "embeddings").withColumn("path", F.concat(F.lit("l"), "label"))
    return context.files_for_issue(v, list(v.orderBy("vec_id").first()["embedding"]))


@query("v28_expand", f"with {_CAT}, a as (select m as id, 'definition' as kind, 1 as priority, 1.0 as score from called union all select target, 'references', 2, 0.9 from rel where kind = 'REFERENCES' and source = (select m from called) union all select target, 'calls', 3, 0.8 from rel where kind = 'CALLS' and source = (select m from called) union all select source, 'calls', 3, 0.8 from rel where kind = 'CALLS' and target = (select m from called) union all select target, 'imports', 4, 0.7 from rel where kind = 'IMPORTS' and source = (select m from called)) select id, kind, priority, score::double as score from (select *, row_number() over (partition by id order by priority, score desc, kind) as r from a) where r = 1")
def v28_expand(s: SparkSession, d: str) -> DataFrame:
    """The context of the most called symbol by the executors of a policy."""
    f = catalogue(s, d)
    return context.retrieve("explain", s.createDataFrame([(_most(f, "CALLS", "target"),)], "moniker string"), f)


@query("v09_entities", "select distinct task_id, unnest(list_concat(list_concat(regexp_extract_all(t, '[A-Za-z0-9_./-]+\\.(?:py|js|jsx|ts|tsx|java|go|rs|md|json)\\b'), regexp_extract_all(t, '`([^`]+)`', 1)), list_concat(regexp_extract_all(t, '\\b([A-Za-z_][A-Za-z0-9_]*)\\(', 1), regexp_extract_all(t, '\\b(?:[A-Z][a-z0-9]+){2,}\\b|\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b')))) as entity from (select task_id, change_description as t from impact_tasks)")
def v09_entities(s: SparkSession, d: str) -> DataFrame:
    """Symbols and files named by each task description."""
    return table(s, d, "impact_tasks").select("task_id", F.explode(api.entities(F.col("change_description"))).alias("entity"))


_WORDS_OF = f"list_filter(list_distinct(regexp_extract_all(lower(change_description), '[a-z_][a-z0-9_]*')), lambda w: len(w) >= 4 and not list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], w))"


@query("r03_seed_files", f"with q as (select task_id as id, unnest(list_transform(list_sort(list_transform({_WORDS_OF}, lambda w: {{'n': -len(w), 'w': w}}))[1:20], lambda x: x.w)) as w from impact_tasks), p as (select distinct path, unnest(list_filter(list_distinct(string_split_regex(lower(path), '[^a-z0-9]+')), lambda x: len(x) >= 4)) as w from (select distinct path from ria_file_unit where path is not null)), h as (select id, path, sum(len(w))::bigint as score from q join p using (w) group by all) select id, path, score from (select *, row_number() over (partition by id order by score desc, path) as r from h) where r <= 10")
def r03_seed_files(s: SparkSession, d: str) -> DataFrame:
    """Seed files of every task description, ten each, a top-k report."""
    t = table(s, d, "impact_tasks").select(F.col("task_id").alias("id"), F.col("change_description").alias("text"))
    return context.seed_files(t, table(s, d, "ria_file_unit").select("path").where("path is not null"))


@query("a21_efforts", None)
def a21_efforts(s: SparkSession, d: str) -> DataFrame:
    """The hours of all recommendations of a repository, in words."""
    from quarrylight.plans.code import r18_recommendations

    out = r18_recommendations(s, d).groupBy("g").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("hours"), 2).alias("hours"))
    return out.withColumn("label", text.hours_label(F.col("hours")))


@query("t13_time_trigger", "with recursive e as (select user_id as key, ts, row_number() over (partition by user_id order by ts) as n from events), f as (select key, ts, n, ts as last, true as fired from e where n = 1 union all select e.key, e.ts, e.n, case when e.ts - f.last >= interval 3600 seconds then e.ts else f.last end, e.ts - f.last >= interval 3600 seconds from f join e on e.key = f.key and e.n = f.n + 1) select key, ts from f where fired")
def t13_time_trigger(s: SparkSession, d: str) -> DataFrame:
    """A keyed streaming state that fires an hour or more after it fired last."""
    from quarrylight.plans.code import _stream

    return _stream(s, d, monitor.POLICIES["time"], mode="append").select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t13_policies", "select 'immediate' as policy, count(*) as fired from events union all select 'manual', 0")
def t13_policies(s: SparkSession, d: str) -> DataFrame:
    """How often the policies without state fire."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), "ts")
    count = lambda n: monitor.POLICIES[n](e).agg(F.count(F.lit(1)).alias("fired")).select(F.lit(n).alias("policy"), "fired")
    return count("immediate").unionByName(count("manual"))


@query("q04_cached", f"with {_CAT} select {_REL} from rel where kind = 'CALLS' and target = (select m from called)")
def q04_cached(s: SparkSession, d: str) -> DataFrame:
    """An answer read from the cache after it was asked once."""
    from quarrylight.cache import ResultCache

    cache, f = ResultCache(), catalogue(s, d)
    top = _most(f, "CALLS", "target")
    ask = lambda: api.find_callers(f, top, 1000).select("repository_id", "commit_sha", "source", "target", "kind")
    cache.get(("r", "c", "FIND_CALLERS", top), ask)
    return cache.get(("r", "c", "FIND_CALLERS", top), ask)


QUERIES, ORACLES = _Q, _O
