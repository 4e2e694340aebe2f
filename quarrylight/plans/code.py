"""Queries over parsed sources, streams and standard relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylight import api
from quarrylight.operators import calls, context, graph, knowledge, resolve
from quarrylight.sources import files as source_files
from quarrylight.sources import parse
from quarrylight.storage import materialize, table
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


def bodies(s: SparkSession, d: str) -> DataFrame:
    """(g, path, language, content): every fetched body of a repository under each of its paths."""
    unit = table(s, d, "ria_file_unit").where("content_hash is not null and path is not null").groupBy("repository_id", "content_hash", "path").agg(F.min("language").alias("language"))
    return table(s, d, "source_files").where("content is not null").join(unit, ["repository_id", "content_hash"]).select(F.col("repository_id").alias("g"), "path", "language", "content")


def facts(s: SparkSession, d: str) -> DataFrame:
    return materialize(parse.extract_facts(bodies(s, d)), "facts")


@query("s08_facts")
def s08_facts(s: SparkSession, d: str) -> DataFrame:
    """Counts of parsed facts by repository and kind."""
    return parse.extract_facts(bodies(s, d)).groupBy("g", "fact", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s10_symbols")
def s10_symbols(s: SparkSession, d: str) -> DataFrame:
    """Every symbol with its lines and parent."""
    return parse.extract_facts(bodies(s, d)).where("fact = 'symbol'").select("g", "path", "kind", "name", "parent", "start", "end")


@query("s11_line_chunks")
def s11_line_chunks(s: SparkSession, d: str) -> DataFrame:
    """Line-window chunks of every body."""
    return parse.line_chunks(bodies(s, d)).select("g", "path", "chunk_id", "start_line", "end_line", F.length("content").alias("chars"))


@query("s12_new_bodies", "select count(*) as bodies from (select distinct content_hash from ria_file_unit where content_hash is not null) anti join (select distinct content_hash from source_files where content is not null) using (content_hash)")
def s12_new_bodies(s: SparkSession, d: str) -> DataFrame:
    """Bodies of the trees that are not stored."""
    tree = table(s, d, "ria_file_unit").where("content_hash is not null").select("content_hash")
    return source_files.new_bodies(tree, table(s, d, "source_files").where("content is not null")).agg(F.count(F.lit(1)).alias("bodies"))


@query("s23_distinct_files", "select repository_id, count(distinct path) as files from ria_file_unit group by 1")
def s23_distinct_files(s: SparkSession, d: str) -> DataFrame:
    """Different paths of each repository."""
    return table(s, d, "ria_file_unit").groupBy("repository_id").agg(F.countDistinct("path").alias("files"))


@query("s20_entry_points")
def s20_entry_points(s: SparkSession, d: str) -> DataFrame:
    """Entry points by manifest and name."""
    return source_files.entry_points(bodies(s, d).select("path", "content"))


@query("j03_file_edges")
def j03_file_edges(s: SparkSession, d: str) -> DataFrame:
    """Dependencies between files by resolved imports."""
    return resolve.file_edges(facts(s, d), bodies(s, d))


@query("j04_module_edges")
def j04_module_edges(s: SparkSession, d: str) -> DataFrame:
    """Dependencies between modules."""
    return resolve.module_edges(facts(s, d))


@query("j05_calls")
def j05_calls(s: SparkSession, d: str) -> DataFrame:
    """Resolved calls counted by tier and confidence."""
    return resolve.resolve_calls(facts(s, d), bodies(s, d)).groupBy("g", "tier", "confidence").agg(F.count(F.lit(1)).alias("calls"))


@query("j07_scopes")
def j07_scopes(s: SparkSession, d: str) -> DataFrame:
    """The innermost symbol around every call, counted by its kind."""
    f = facts(s, d)
    scopes = f.where("fact = 'symbol'").select("g", "path", "start", "end", F.concat_ws(":", "kind", F.concat_ws(".", "parent", "name")).alias("scope"))
    points = f.where("fact = 'call'").select("g", "path", F.col("start").alias("at"), F.monotonically_increasing_id().alias("id"))
    return resolve.enclosing_scopes(points, scopes).groupBy("g", F.split("scope", ":")[0].alias("kind")).agg(F.count(F.lit(1)).alias("calls"))


@query("j09_inherited")
def j09_inherited(s: SparkSession, d: str) -> DataFrame:
    """The definition that each class uses for a method."""
    return resolve.inherited_methods(facts(s, d))


@query("p05_visibility")
def p05_visibility(s: SparkSession, d: str) -> DataFrame:
    """Symbols by visibility and rule, with those nobody calls."""
    f, key = facts(s, d), ["g", "path", "name"]
    exported = f.where("fact = 'export'").select(*key, F.lit(True).alias("exported")).distinct()
    exports = f.where("fact = 'export'").groupBy("g", "path").agg(F.countDistinct("name").cast("int").alias("exports"))
    marks = f.where("fact = 'decorator'").groupBy(*key).agg(F.concat_ws(" ", F.array_sort(F.collect_set("detail"))).alias("decorators"))
    fan = f.where("fact = 'call'").groupBy("g", "name").agg(F.count(F.lit(1)).alias("fan_in"))
    lines = bodies(s, d).select("g", "path", F.split("content", "\n").alias("lines"), (F.col("content").contains("__name__") & F.col("content").contains("__main__")).alias("main_guard"))
    sym = f.where("fact = 'symbol'").join(exported, key, "left").join(exports, ["g", "path"], "left").join(marks, key, "left").join(fan, ["g", "name"], "left").join(lines, ["g", "path"], "left")
    sym = sym.withColumns({"entry": F.lit(False), "exports": F.coalesce("exports", F.lit(0)), "nearby": F.array_join(F.slice("lines", F.greatest(F.lit(1), F.col("start") - 2), F.lit(5)), "\n")}).drop("lines")
    return resolve.visibility(sym).groupBy("g", "visibility", "rule", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("is_orphan")).alias("orphans"))


@query("j17_test_evidence")
def j17_test_evidence(s: SparkSession, d: str) -> DataFrame:
    """Tests that share facts with the most called functions."""
    from quarrylight.functions import paths

    f = facts(s, d)
    hot = f.where("fact = 'call'").groupBy("g", "name").agg(F.count(F.lit(1)).alias("n"))
    targets = f.where("fact = 'symbol'").join(hot.where("n > 1"), ["g", "name"]).select("g", "path", "name")
    return resolve.test_evidence(f.where(paths.is_test_path(F.col("path"))), targets)


# ---------------------------------------------------------------- questions, knowledge graphs and findings

def catalogue(s: SparkSession, d: str) -> api.Facts:
    """The edges that count as symbols and relations: every node is a symbol of its kind."""
    from quarrylight.plans.pipeline import counting_edges

    e = counting_edges(s, d, "kind", "source_id", "target_id").select("repository_id", "commit_sha", "source_id", "target_id", F.lower(F.trim("kind")).alias("kind"))
    n = e.select("repository_id", "commit_sha", F.explode(F.array("source_id", "target_id")).alias("moniker")).distinct()
    name = F.regexp_extract("moniker", r"([^/#.:@]+)$", 1)
    symbols = n.select("repository_id", "commit_sha", "moniker", name.alias("name"), F.regexp_extract("moniker", r"#(.*)$", 1).alias("qualified"), F.split("moniker", ":")[0].alias("kind"), F.regexp_extract("moniker", r"^\w+:[^:]*:([^#]*)", 1).alias("path"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("parent"))
    kinds = F.when(F.col("kind") == "calls", "CALLS").when(F.col("kind") == "imports", "IMPORTS").when(F.col("kind") == "extends", "INHERITS_FROM").when(F.col("kind").isin("references", "uses"), "REFERENCES").otherwise("DEFINES")
    relations = e.select("repository_id", "commit_sha", F.col("source_id").alias("source"), F.col("target_id").alias("target"), kinds.alias("kind"), F.regexp_extract("source_id", r"^\w+:[^:]*:([^#]*)", 1).alias("path"), F.lit(0).alias("line")).distinct()
    return api.Facts(symbols, relations)


_LIVE = """live as (select distinct repository_id, commit_sha, source_id as s, target_id as t, lower(trim(kind)) as kind from (select *, row_number() over (partition by repository_id, commit_sha, edge_id order by delivered_at desc) rn from ria_graph_edge) where rn = 1)"""


@query("q01_relation_kinds", f"with {_LIVE}, r as (select distinct repository_id, commit_sha, s, t, case kind when 'calls' then 'CALLS' when 'imports' then 'IMPORTS' when 'extends' then 'INHERITS_FROM' when 'references' then 'REFERENCES' when 'uses' then 'REFERENCES' else 'DEFINES' end as kind from live) select repository_id, kind, count(*) as relations, count(distinct s) as sources from r group by all")
def q01_relation_kinds(s: SparkSession, d: str) -> DataFrame:
    """Q01, Q06: relations of each kind in all commits of a repository."""
    return catalogue(s, d).r.groupBy("repository_id", "kind").agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("source").alias("sources"))


@query("q01_callers", f"with {_LIVE}, top as (select t from live where kind = 'calls' group by t order by count(*) desc, t limit 1) select distinct repository_id, commit_sha, s as source, t as target from live where kind = 'calls' and t = (select t from top)")
def q01_callers(s: SparkSession, d: str) -> DataFrame:
    """Q01: callers of the most called symbol."""
    f = catalogue(s, d)
    top = f.r.where("kind = 'CALLS'").groupBy("target").count().orderBy(F.desc("count"), "target").first()["target"]
    return api.find_callers(f, top, 1000).select("repository_id", "commit_sha", "source", "target")


@query("q11_intents", "select task_id, case " + " ".join(f"when regexp_matches(lower(change_description), '\\b(?:{w})') then '{n}'" for n, w in api.INTENTS) + " else 'general' end as intent from impact_tasks")
def q11_intents(s: SparkSession, d: str) -> DataFrame:
    """Q11, Q12: the intent of every task description."""
    return table(s, d, "impact_tasks").select("task_id", api.intent(F.col("change_description")).alias("intent"))


@query("j26_knowledge_graph")
def j26_knowledge_graph(s: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the knowledge graph by kind."""
    b, f = bodies(s, d), facts(s, d)
    nodes, edges = knowledge.knowledge_graph({"files": b, "facts": f, "file_edges": resolve.file_edges(f, b)})
    return knowledge.breakdown(nodes, edges)


@query("j27_directories", "with f as (select distinct repository_id as g, path from ria_file_unit where path is not null), c as (select g, path, unnest(range(1, len(string_split(path, '/')))) as i from f), dirs as (select distinct g, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir from c) select g, (select count(*) from dirs x where x.g = f.g) as directories, count(*) as files from f group by g")
def j27_directories(s: SparkSession, d: str) -> DataFrame:
    """Directories and files of each repository."""
    files = table(s, d, "ria_file_unit").select(F.col("repository_id").alias("g"), "path")
    nodes, _ = knowledge.directories({"files": files})
    return nodes.groupBy("g").agg(F.count_if(F.expr("kind = 'directory'")).alias("directories"), F.count_if(F.expr("kind = 'file'")).alias("files"))


@query("r11_inspection")
def r11_inspection(s: SparkSession, d: str) -> DataFrame:
    """Findings of all packs by category and severity."""
    from quarrylight.operators import scoring

    b = bodies(s, d)
    units = table(s, d, "ria_file_unit").select(F.col("repository_id").alias("g"), "path", "size_bytes")
    metrics = b.select("g", "path", scoring.cyclomatic(F.col("content")).alias("complexity"))
    packs = [knowledge.complexity_findings(metrics), knowledge.large_file_findings(units), knowledge.documentation_findings(units), knowledge.testing_findings(units), knowledge.security_findings(b)]
    return knowledge.inspection(packs).groupBy("g", "category", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("r18_recommendations")
def r18_recommendations(s: SparkSession, d: str) -> DataFrame:
    """Work by priority and phase for each repository."""
    units = table(s, d, "ria_file_unit").select(F.col("repository_id").alias("g"), "path", "size_bytes")
    found = knowledge.inspection([knowledge.large_file_findings(units), knowledge.documentation_findings(units), knowledge.testing_findings(units)])
    return knowledge.recommendations(found)


@query("w03_reading_tiers")
def w03_reading_tiers(s: SparkSession, d: str) -> DataFrame:
    """Rank and tier of each node of the dependency graphs."""
    from quarrylight.plans.graphs import dependencies

    e = dependencies(s, d)
    entries = graph.small_starts(e).withColumnRenamed("start", "node")
    return knowledge.rank_and_tier(graph.reading_scores(e, entries), entries)


@query("w11_graph_sample")
def w11_graph_sample(s: SparkSession, d: str) -> DataFrame:
    """The most central nodes of each graph, a sampling operator."""
    from quarrylight.plans.graphs import dependencies

    e = dependencies(s, d)
    return knowledge.graph_sample(e, graph.centrality(e), 50)


@query("j30_boundaries", None)
def j30_boundaries(s: SparkSession, d: str) -> DataFrame:
    """Dependencies that cross components."""
    from quarrylight.plans.graphs import dependencies

    return knowledge.boundary_crossings(dependencies(s, d))


@query("g03_depth_first")
def g03_depth_first(s: SparkSession, d: str) -> DataFrame:
    """Preorder from the start of each graph."""
    from quarrylight.plans.graphs import dependencies

    e = dependencies(s, d)
    return calls.depth_first(e, graph.small_starts(e))


@query("w02_best_first")
def w02_best_first(s: SparkSession, d: str) -> DataFrame:
    """The reading order of each graph, fifty nodes."""
    from quarrylight.plans.graphs import dependencies

    e = dependencies(s, d)
    entries = graph.small_starts(e).withColumnRenamed("start", "node")
    scored = graph.reading_scores(e, entries).join(entries.withColumn("entry", F.lit(True)), ["g", "node"], "left").na.fill(False, ["entry"])
    return calls.best_first(e, scored)


_DEP = """dl as (select distinct repository_id || '@' || commit_sha as g, source_id as src, target_id as dst from (select *, row_number() over (partition by repository_id, commit_sha, edge_id order by delivered_at desc) rn from ria_graph_edge) where rn = 1 and lower(trim(kind)) in ('calls','imports','uses','references','extends'))"""


@query("a07_call_graph", f"with {_DEP}, deg as (select g, node, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select g, src as node, 0 as i, 1 as o from dl union all select g, dst, 1, 0 from dl) group by all) select g, node, fan_in, fan_out, fan_in = 0 as is_entry, exists (select 1 from dl where dl.g = deg.g and dl.src = deg.node and dl.dst = deg.node) as is_recursive from deg")
def a07_call_graph(s: SparkSession, d: str) -> DataFrame:
    """Fan-in, fan-out, entries and recursion of each node."""
    from quarrylight.plans.graphs import dependencies

    e = dependencies(s, d).select("g", F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(1).alias("line"), F.lit("HIGH").alias("confidence"))
    return calls.call_graph(e)[1]


@query("g13_caller_closure")
def g13_caller_closure(s: SparkSession, d: str) -> DataFrame:
    """Callers within three steps with path, tier and layer transitions."""
    from quarrylight.plans.graphs import dependencies

    e = dependencies(s, d)
    found = calls.caller_closure(e, graph.small_starts(e, "dst"))
    return calls.layer_transitions(found).withColumn("path", F.array_join("path", " > "))


@query("g24_module_dependencies", f"with {_DEP}, m as (select distinct g, regexp_replace(regexp_replace(src, '#.*$', ''), '/[^/]*$', '') as module, regexp_replace(regexp_replace(dst, '#.*$', ''), '/[^/]*$', '') as other from dl) select g, module, array_to_string(list_sort(list(other)), ',') as depends_on from m where module <> other group by all")
def g24_module_dependencies(s: SparkSession, d: str) -> DataFrame:
    """What each module depends on."""
    from quarrylight.plans.graphs import dependencies

    return calls.module_dependencies(dependencies(s, d)).withColumn("depends_on", F.array_join("depends_on", ","))


@query("g26_architecture_findings")
def g26_architecture_findings(s: SparkSession, d: str) -> DataFrame:
    """Layer violations, unused nodes and hotspots."""
    from quarrylight.plans.graphs import dependencies

    return calls.architecture_findings(dependencies(s, d))


@query("p18_word_references")
def p18_word_references(s: SparkSession, d: str) -> DataFrame:
    """How many files mention each symbol as a word."""
    b, f = bodies(s, d), facts(s, d)
    return context.references_symbol(b, f.where("fact = 'symbol'")).groupBy("g", "name").agg(F.count(F.lit(1)).alias("files"))


@query("v01_hashed_vectors")
def v01_hashed_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by the built-in backend."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return context.hashed_vectors(docs).select("id", F.size("embedding").alias("dims"))


@query("r33_dependency_story", f"with {_DEP}, o as (select g, src as node, array_to_string(list_sort(list(dst)), ', ') as uses from dl group by all), i as (select g, dst as node, array_to_string(list_sort(list(src)), ', ') as used from dl group by all) select g, node, concat_ws('; ', 'uses ' || uses, 'is used by ' || used) as text from o full join i using (g, node)")
def r33_dependency_story(s: SparkSession, d: str) -> DataFrame:
    """Each node's neighbours as a sentence."""
    from quarrylight.plans.graphs import dependencies

    return context.dependency_story(dependencies(s, d))


@query("v36_topic_switches", "with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts) as p from events) select user_id as conversation, event_id as turn, 'EXPLICIT_ENTITY' as kind, 0.99::double as confidence from l where p is not null and event_type <> p")
def v36_topic_switches(s: SparkSession, d: str) -> DataFrame:
    """Turns at which the subject changes."""
    e = table(s, d, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    turns = e.select(F.col("user_id").alias("conversation"), order.alias("turn"), F.col("event_type").alias("entity"), F.lit("f").alias("file"), "event_id")
    found = knowledge.topic_switches(turns)
    return found.join(turns.select("conversation", "turn", "event_id"), ["conversation", "turn"]).select("conversation", F.col("event_id").alias("turn"), "kind", "confidence")


# ---------------------------------------------------------------- streams

_EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def _stream(s: SparkSession, d: str, build, mode: str = "complete") -> DataFrame:
    return monitor.run_available(s, f"{d}/event[s].parquet", _EVENTS, lambda x: build(_events(x).withWatermark("ts", "10 minutes")), watermark=None, mode=mode)


@query("t12_tumbling_stream", "select date_trunc('hour', ts) as start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def t12_tumbling_stream(s: SparkSession, d: str) -> DataFrame:
    """Hourly windows by a streaming query over all files."""
    return _stream(s, d, monitor.tumbling).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t12_sliding_stream", "select start, count(*) as events from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events) group by 1")
def t12_sliding_stream(s: SparkSession, d: str) -> DataFrame:
    """Overlapping windows by a streaming query."""
    return _stream(s, d, monitor.sliding).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t17_sessions", "with g as (select user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by key order by ts) as sid from g) select key, min(ts) as start, max(ts) as end, count(*) as events from s group by key, sid")
def t17_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of each key with a gap of thirty minutes."""
    out = monitor.sessions(_events(table(s, d, "events")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("t13_count_trigger", "select user_id as key, ts from (select *, row_number() over (partition by user_id order by ts) n from events) where n % 5 = 0")
def t13_count_trigger(s: SparkSession, d: str) -> DataFrame:
    """A keyed streaming state that fires on every fifth event of a key."""
    out = _stream(s, d, monitor.count_trigger(5), mode="append")
    return out.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t14_significant", "with m as (select user_id as key, date_trunc('day', ts) as day, avg(value) as score from events group by all), c as (select *, score - lag(score) over (partition by key order by day) as change from m) select key, day as at, round(change, 6) as change, coalesce(change < -5, false) as significant from c")
def t14_significant(s: SparkSession, d: str) -> DataFrame:
    """Daily scores that fell."""
    daily = table(s, d, "events").groupBy(F.col("user_id").alias("key"), F.date_trunc("day", "ts").alias("at")).agg(F.avg("value").alias("score"))
    return monitor.significant(daily).withColumn("change", F.round("change", 6)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("t22_upsert_latest", "select user_id as key, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def t22_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """The state table of latest events after a batch of changes."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return monitor.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["key"], "ts")


@query("t21_incremental_plan", "with o as (select path, max(content_hash) as h from ria_file_unit where delivered_at < (select median(delivered_at) from ria_file_unit) group by 1), n as (select path, max(content_hash) as h from ria_file_unit where delivered_at >= (select median(delivered_at) from ria_file_unit) group by 1) select case when n.path is null then 'delete' else 'reindex' end as action, count(*) as files from o full join n using (path) where n.h is distinct from o.h group by 1")
def t21_incremental_plan(s: SparkSession, d: str) -> DataFrame:
    """Files to index anew or to delete between two states."""
    u = table(s, d, "ria_file_unit")
    mid = u.agg(F.median(F.unix_micros(F.col("delivered_at").cast("timestamp"))).alias("m")).first()["m"]
    at = F.unix_micros(F.col("delivered_at").cast("timestamp"))
    old = u.where(at < mid).groupBy("path").agg(F.max("content_hash").alias("hash"))
    new = u.where(at >= mid).groupBy("path").agg(F.max("content_hash").alias("hash"))
    plan = monitor.incremental_plan(new, old, s.createDataFrame([], "path string"))
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------- standard relational operators

@query("q_join_aggregate", "select n_name, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all")
def q_join_aggregate(s: SparkSession, d: str) -> DataFrame:
    """Equal joins and a grouped aggregate."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q_semi_anti", "select (select count(*) from customer semi join orders on o_custkey = c_custkey) as with_orders, (select count(*) from customer anti join orders on o_custkey = c_custkey) as without")
def q_semi_anti(s: SparkSession, d: str) -> DataFrame:
    """Semi and anti join."""
    c, o = table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return c.join(o, "c_custkey", "left").agg(F.count_if(F.col("has").isNotNull()).alias("with_orders"), F.count_if(F.col("has").isNull()).alias("without"))


@query("q_full_outer", "select coalesce(a.k, b.k) as k, coalesce(x, 0) as x, coalesce(y, 0) as y from (select l_partkey as k, count(*) as x from lineitem where l_returnflag = 'A' group by 1) a full join (select l_partkey as k, count(*) as y from lineitem where l_returnflag = 'R' group by 1) b on a.k = b.k")
def q_full_outer(s: SparkSession, d: str) -> DataFrame:
    """Full outer join with defaults."""
    li = table(s, d, "lineitem")
    a = li.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    b = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, "k", "full").na.fill(0)


@query("q_cube", "select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::int as level, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def q_cube(s: SparkSession, d: str) -> DataFrame:
    """All groupings of two keys."""
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("q_pivot", "select o_custkey, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def q_pivot(s: SparkSession, d: str) -> DataFrame:
    """A pivot with stated values, one pass."""
    out = table(s, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("q_unpivot", "select l_orderkey, l_linenumber, l_partkey, m, round(sum(v), 4) as v from (select l_orderkey, l_linenumber, l_partkey, unnest(['discount', 'tax']) as m, unnest([l_discount, l_tax]) as v from lineitem) group by all")
def q_unpivot(s: SparkSession, d: str) -> DataFrame:
    """Columns to rows."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "m", "v").groupBy("l_orderkey", "l_linenumber", "l_partkey", "m").agg(F.round(F.sum("v"), 4).alias("v"))


@query("q_percentiles", "select o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.95), 4) as p95 from orders group by 1")
def q_percentiles(s: SparkSession, d: str) -> DataFrame:
    """Exact percentiles."""
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"))


@query("q_windows", "select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, round(coalesce(lag(o_totalprice) over w, 0), 2) as prev, round(sum(o_totalprice) over (w rows between unbounded preceding and current row), 2) as running from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def q_windows(s: SparkSession, d: str) -> DataFrame:
    """Ranking, offset and frame functions over one sort."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.round(F.coalesce(F.lag("o_totalprice").over(w), F.lit(0.0)), 2).alias("prev"), F.round(running, 2).alias("running"))


@query("q_set_operations", "select 'intersect' as op, k from (select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') union all select 'except', k from (select o_custkey as k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P')")
def q_set_operations(s: SparkSession, d: str) -> DataFrame:
    """Intersection and difference of sets."""
    o = table(s, d, "orders")
    k = {x: o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FOP"}
    return k["F"].intersect(k["O"]).select(F.lit("intersect").alias("op"), "k").unionByName(k["F"].subtract(k["P"]).select(F.lit("except").alias("op"), "k"))


@query("q_range_join", "select e.event_type, count(*) as pairs from events e join (select event_id, user_id, ts from events where event_type = 'purchase') p on p.user_id = e.user_id and p.ts > e.ts and p.ts <= e.ts + interval 2 hours where e.event_type in ('click', 'view') group by 1")
def q_range_join(s: SparkSession, d: str) -> DataFrame:
    """An interval join made equal by blocks of the range, no nested loop."""
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    hours = 2 * 3600 * 1_000_000
    left = e.where("event_type in ('click', 'view')").withColumn("b", F.explode(F.array(F.expr(f"t div {hours}"), F.expr(f"t div {hours} + 1"))))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("t2"), F.expr(f"t div {hours}").alias("b"))
    return left.join(right, ["user_id", "b"]).where(f"t2 > t and t2 <= t + {hours}").groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"))


@query("q_json_map", "select (props->>'$.k')::int % 10 as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1")
def q_json_map(s: SparkSession, d: str) -> DataFrame:
    """JSON fields with a stated schema."""
    e = table(s, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy((F.col("p.k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("q_hierarchy_cte", "with recursive t as (select p_partkey, 0 as depth from part where p_partkey = 0 union all select p.p_partkey, t.depth + 1 from t join part p on p.p_partkey // 2 = t.p_partkey and p.p_partkey > 0) select depth, count(*) as parts from t group by 1")
def q_hierarchy_cte(s: SparkSession, d: str) -> DataFrame:
    """A hierarchy's nodes by depth through the frontier operator."""
    p = table(s, d, "part").where("p_partkey > 0")
    e = p.select(F.lit("p").alias("g"), F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    start = s.createDataFrame([("p", 0)], "g string, start long")
    return graph.reach(e, start).groupBy("depth").agg(F.count(F.lit(1)).alias("parts"))


QUERIES, ORACLES = _Q, _O
