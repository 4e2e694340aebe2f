"""Queries over files, histories, findings, symbols and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import paths, text
from quarrylight.operators import diff, history, scoring, search
from quarrylight.storage import latest_rows, table

_Q: dict = {}
_O: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql:
            _O[name] = sql
        return f

    return keep


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _ends(column: str, endings) -> str:
    return "(" + " or ".join(f"ends_with({column}, '{e}')" for e in endings) + ")"


def _has(column: str, words: str) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words.split()) + ")"


# ---------------------------------------------------------------- paths

def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ria_file_unit").select("path").where("path is not null").distinct()


_P = """f as (select distinct path, ltrim(lower(trim(replace(path, '\\', '/'))), '/') as p from ria_file_unit where path is not null),
q as (select path, p, string_split(p, '/') as parts, string_split(p, '/')[-1] as name from f),
x as (select *, list_slice(parts, 1, len(parts) - 1) as dirs, regexp_extract(name, '^.+(\\.[^.]*)$', 1) as ext from q)"""

_CATEGORY = f"""case when list_has_any(dirs, {_list(paths.IGNORED_DIRS)}) or list_contains({_list(paths.GENERATED_NAMES)}, name) or {_ends('p', paths.GENERATED_EXTENSIONS)} or {_ends('name', ['_pb2.py', '_pb2_grpc.py'])} then 'generated'
 when list_has_any(dirs, {_list(paths.EXAMPLE_DIRS)}) then 'example'
 when list_has_any(dirs, {_list(paths.TEST_DIRS)}) or starts_with(name, 'test_') or {_ends('name', paths.TEST_SUFFIXES)} then 'test'
 when list_contains({_list(paths.CONFIG_NAMES)}, name) or starts_with(name, 'requirements') then 'config'
 when list_has_any(dirs, {_list(paths.DOCS_DIRS)}) or list_contains({_list(paths.DOCS_EXTENSIONS)}, ext) or (ext = '' and ({' or '.join(f"starts_with(name, '{x}')" for x in paths.DOCS_PREFIXES)})) then 'docs' else 'production' end"""

_LANGUAGE = "case " + " ".join(f"when list_contains({_list(e.split())}, ext) then '{n}'" for n, e in paths.LANGUAGE_OF.items()) + " else 'Unknown' end"


def _layer_sql(p: str) -> str:
    out = "case"
    for label, words, names in paths.LAYERS:
        hit = _has(p, words)
        if names:
            hit += f" or list_contains({_list(names.split())}, string_split({p}, '/')[-1])"
        if label == "Presentation":
            hit += f" or {_ends(p, paths.PRESENTATION_ENDINGS)}"
        out += f" when {hit} then '{label}'"
    return out + " else 'Domain' end"


@query("p01_categories", f"with {_P} select path, {_CATEGORY} as category, {_LANGUAGE} as language from x")
def p01_categories(s: SparkSession, d: str) -> DataFrame:
    """Category and language of every path."""
    return _paths(s, d).select("path", paths.category(F.col("path")).alias("category"), paths.language(F.col("path")).alias("language"))


@query("p01_weights", f"""with {_P}, c as (select {_CATEGORY} as category from x) select category, count(*) as files,
 any_value(case category when 'production' then 1.0 when 'docs' then 0.6 when 'example' then 0.4 when 'test' then 0.3 when 'config' then 0.2 else 0.0 end)::double as priority,
 any_value(case category when 'production' then 10.0 when 'config' then 2.0 when 'example' then 2.0 when 'test' then 1.0 when 'docs' then 0.1 else 0.0 end)::double as weight from c group by category""")
def p01_weights(s: SparkSession, d: str) -> DataFrame:
    """Files by category with retrieval priority and stack weight."""
    c = _paths(s, d).groupBy(paths.category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("files"))
    return c.select("category", "files", paths.source_priority(F.col("category")).alias("priority"), paths.stack_weight(F.col("category")).alias("weight"))


@query("p02_layers", f"select layer, count(*) as files from (select {_layer_sql('p')} as layer from (select distinct path, lower(path) as p from ria_file_unit where path is not null)) group by layer")
def p02_layers(s: SparkSession, d: str) -> DataFrame:
    """Files by architectural layer."""
    return _paths(s, d).groupBy(paths.layer(F.col("path")).alias("layer")).agg(F.count(F.lit(1)).alias("files"))


@query("p03_patterns", None)
def p03_patterns(s: SparkSession, d: str) -> DataFrame:
    """Design patterns named by paths and bodies, with the number of bodies, each under all its paths."""
    units = table(s, d, "ria_file_unit").select("repository_id", "content_hash", "path").where("path is not null").distinct()
    bodies = table(s, d, "source_files").where("content is not null").join(units, ["repository_id", "content_hash"])
    tags = bodies.select(F.explode(paths.design_patterns(F.col("path"), F.col("content"))).alias("pattern"))
    return tags.groupBy("pattern").agg(F.count(F.lit(1)).alias("bodies"))


@query("p08_ignored", "select path, (regexp_matches(lower(path), '(^|/)tests(/|$)') or ends_with(lower(path), '.json') or regexp_matches(string_split(lower(path), '/')[-1], '^test_')) as ignored from (select distinct path from ria_file_unit where path is not null)")
def p08_ignored(s: SparkSession, d: str) -> DataFrame:
    """Paths that a list of globs leaves out."""
    return _paths(s, d).select("path", paths.is_ignored(F.col("path"), ["tests/", "*.json", "test_*"]).alias("ignored"))


@query("p12_components", "select component, count(*) as files from (select distinct path, unnest([" + ", ".join(f"case when regexp_matches(lower(path), '{r}') then '{k}' end" for k, r in paths.COMPONENTS.items()) + "]) as component from ria_file_unit where path is not null) where component is not null group by component")
def p12_components(s: SparkSession, d: str) -> DataFrame:
    """Files by component, a file may have several."""
    return _paths(s, d).select(F.explode(paths.components(F.col("path"))).alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("files"))


@query("f03_modules", r"select distinct path, regexp_replace(replace(regexp_replace(path, '\.[^./]+$', ''), '/', '.'), '\.__init__$', '') as module, regexp_extract(path, '[^/]*$') as name, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from ria_file_unit where path is not null")
def f03_modules(s: SparkSession, d: str) -> DataFrame:
    """module, base name and folder of every path."""
    p = F.col("path")
    return _paths(s, d).select("path", paths.module_of(p).alias("module"), paths.file_name(p).alias("name"), paths.directory(p).alias("dir"))


@query("f17_valid_paths", r"select count(*) filter (path <> '' and not regexp_matches(path, '^/|\\|//|/$|(^|/)\.{1,2}(/|$)')) as valid, count(*) as paths from (select distinct path from ria_file_unit where path is not null)")
def f17_valid_paths(s: SparkSession, d: str) -> DataFrame:
    """How many paths are canonical."""
    return _paths(s, d).agg(F.count_if(paths.is_valid_relative(F.col("path"))).alias("valid"), F.count(F.lit(1)).alias("paths"))


# ---------------------------------------------------------------- hashes and text

@query("f01_content_hash", "select doc_id, sha256(text) as hash, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as key from documents where text is not null")
def f01_content_hash(s: SparkSession, d: str) -> DataFrame:
    """Content hash and deduplication key of every text."""
    return table(s, d, "documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("hash"), diff.text_key(F.col("text")).alias("key"))


@query("f01_repository_hash", "select repository_id, commit_sha, sha256(string_agg(path || content_hash, '' order by path, content_hash)) as hash from (select * from (select *, row_number() over (partition by repository_id, commit_sha, path order by delivered_at desc) rn from ria_file_unit) where rn = 1) group by all")
def f01_repository_hash(s: SparkSession, d: str) -> DataFrame:
    """The ordered hash of every snapshot's manifest."""
    units = latest_rows(table(s, d, "ria_file_unit").select("repository_id", "commit_sha", "path", "content_hash", "delivered_at"), ["repository_id", "commit_sha", "path"], "delivered_at")
    return units.groupBy("repository_id", "commit_sha").agg(text.ordered_hash(F.col("path"), F.col("content_hash")).alias("hash"))


@query("f02_cache_key", None)
def f02_cache_key(s: SparkSession, d: str) -> DataFrame:
    """the cache key of every body that is one piece for a model, in any script; p3_pieces keys the pieces of longer ones."""
    models = table(s, d, "embedding_model").select("model_name", "model_version", "max_chars").limit(1001).collect()
    if len(models) > 1000:
        raise ValueError("more than 1000 models where a small table was expected")
    bodies = table(s, d, "source_files").select("repository_id", "content_hash", "content").where("content is not null")
    each = F.array(*[F.struct(F.lit(m[0]).alias("model_name"), F.lit(m[1]).alias("model_version"), F.lit(m[2]).alias("max_chars")) for m in models])
    fits = bodies.select("repository_id", "content_hash", "content", F.inline(each)).where("char_length(content) <= max_chars")
    return fits.select("model_name", "repository_id", "content_hash", text.cache_key(F.col("model_name"), F.col("model_version"), F.col("content")).alias("chunk_hash"))


@query("f06_queries", r"select task_id, lower(trim(regexp_replace(trim(regexp_replace(replace(change_description, '`', ''), '\s+', ' ', 'g')), '[?!.,]+$', ''))) as query from impact_tasks")
def f06_queries(s: SparkSession, d: str) -> DataFrame:
    """Normalised questions."""
    return table(s, d, "impact_tasks").select("task_id", text.normalised_query(F.col("change_description")).alias("query"))


@query("f12_camel", "select p_partkey as id, p_name as name, contains(regexp_replace(p_brand, '[^A-Z]', '', 'g'), 'B') as camel from part")
def f12_camel(s: SparkSession, d: str) -> DataFrame:
    """Capitals of a name that hold the query's."""
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), text.camel_match(F.col("p_brand"), F.lit("b")).alias("camel"))


@query("f15_repository_names", r"select repository_id, lower(regexp_replace(regexp_replace(trim(origin_url), '^(?:[a-z+]+://)?(?:[^@/]+@)?[^/:]+[/:]', ''), '(?:\.git)?/*$', '')) as name, regexp_replace(trim(default_branch), '^refs/(?:heads|tags|remotes/[^/]+)/', '') as branch from ria_repository")
def f15_repository_names(s: SparkSession, d: str) -> DataFrame:
    """Normalised repository and branch names."""
    return table(s, d, "ria_repository").select("repository_id", text.repository_name(F.col("origin_url")).alias("name"), text.ref_name(F.col("default_branch")).alias("branch"))


@query("v05_overlap", None)
def v05_overlap(s: SparkSession, d: str) -> DataFrame:
    """Share of a question's tokens in each document."""
    q = F.lit("which files does the frozen scanner of the token index change")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.round(text.overlap(q, F.col("text")), 6).alias("overlap"))


# ---------------------------------------------------------------- histories

def _touches(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    status = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return e.select(F.col("event_id").alias("hash"), F.col("user_id").alias("author"), "ts", F.expr("concat('dir', event_id % 7, '/f', event_id % 200)").alias("path"), status.alias("status"))


_T = "t as (select event_id as hash, user_id as author, ts, 'dir' || (event_id % 7) || '/f' || (event_id % 200) as path, case event_type when 'signup' then 'added' when 'error' then 'deleted' else 'modified' end as status from events)"
_CHURN = f"""{_T}, n as (select path, author, count(*) as n from t group by all), p as (select path, count(*) as commits, max(ts) as last_ts, max_by(status, ts) = 'deleted' as is_deleted from t group by path),
o as (select path, max(n) as top, count(*) as authors, arg_min(author, (-n, author)) as primary_author from n group by path),
churned as (select path, commits, last_ts, is_deleted, round(100.0 * commits / max(commits) over (), 2) as score, primary_author, authors, top / commits > 0.8 as bus_factor_risk from p join o using (path))"""


@query("a01_churn", f"with {_CHURN} select * from churned")
def a01_churn(s: SparkSession, d: str) -> DataFrame:
    """Churn, primary author and bus factor of each path."""
    return history.churn(_touches(s, d))


@query("a04_ownership", f"with {_CHURN} select path, commits, round(100.0 * top / commits, 1) as share, primary_author as owner from churned join o using (path, primary_author, authors) order by commits desc, path limit 50")
def a04_ownership(s: SparkSession, d: str) -> DataFrame:
    """Owners of the paths with the most commits."""
    return history.ownership(_touches(s, d)).drop("histogram")


@query("a05_weekly", f"with {_T} select date_trunc('week', ts)::date as week, count(distinct hash) as commits, count(distinct path) as files, array_to_string(list_sort(list(distinct author::varchar)), ',') as authors from t group by 1")
def a05_weekly(s: SparkSession, d: str) -> DataFrame:
    """Commits, files and authors of each week."""
    return history.weekly(_touches(s, d))


@query("a14_hotspots", f"with {_CHURN}, c as (select path, (length(path) % 5) / 4.0 as centrality from churned), b as (select string_split(path, '/')[-1] as name, arg_min(centrality, path) as c2 from c where centrality <> 0 group by 1) select h.path, h.score, round(coalesce(nullif(c.centrality, 0), b.c2, 0), 4) as centrality, round(h.score * (1 + coalesce(nullif(c.centrality, 0), b.c2, 0)), 4) as hotspot from churned h join c using (path) left join b on b.name = string_split(h.path, '/')[-1] order by hotspot desc, path limit 20")
def a14_hotspots(s: SparkSession, d: str) -> DataFrame:
    """Churn times centrality."""
    churned = history.churn(_touches(s, d))
    central = churned.select("path", ((F.length("path") % 5) / 4.0).alias("centrality"))
    return history.hotspots(churned, central)


@query("a18_trends", """with p as (select o_orderpriority as series, date_trunc('month', o_orderdate) as ts, count(*)::double as value from orders group by all),
l as (select *, value - lag(value) over (partition by series order by ts) as d from p),
g as (select series, count(*) as points, (arg_max(value, ts) - arg_min(value, ts)) / greatest(count(*) - 1, 1) as slope, coalesce(stddev_pop(d), 0) as volatility, max(abs(value)) as top from l group by series)
select series, points, round(slope, 6) as slope, case when slope > 1e-4 then 'improving' when slope < -1e-4 then 'degrading' else 'stable' end as direction,
case when abs(slope) >= 1 then 'fast' when abs(slope) >= 0.1 then 'moderate' else 'slow' end as velocity, round(volatility, 6) as volatility, round(greatest(0, 1 - volatility / top) * case when points < 3 then 0.7 else 1 end, 6) as confidence from g""")
def a18_trends(s: SparkSession, d: str) -> DataFrame:
    """Slope, direction, velocity and volatility of monthly counts."""
    p = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("at")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = history.trend(p)
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "volatility", "confidence")})


@query("a29_index_states", "select repository_id, index_state, count(*) as commits from ria_commit group by all")
def a29_index_states(s: SparkSession, d: str) -> DataFrame:
    """Commits by index state of each repository."""
    return table(s, d, "ria_commit").groupBy("repository_id", "index_state").agg(F.count(F.lit(1)).alias("commits"))


@query("s14_latest_queryable", "select repository_id, arg_max(sha, (committed_at::timestamptz, sha)) as sha from ria_commit where index_state = 'queryable' and committed_at is not null group by 1")
def s14_latest_queryable(s: SparkSession, d: str) -> DataFrame:
    """The newest commit of each repository that can be queried, by instant."""
    c = table(s, d, "ria_commit").where("index_state = 'queryable' and committed_at is not null")
    return c.groupBy("repository_id").agg(F.max_by("sha", F.struct(F.to_timestamp("committed_at").alias("t"), "sha")).alias("sha"))


@query("s13_commit_discovery", "select repository_id, sha, json_array_length(parents) > 1 as is_merge from ria_commit where json_array_length(parents) > 1 or json_array_length(parents) = 0")
def s13_commit_discovery(s: SparkSession, d: str) -> DataFrame:
    """First and merge commits, the merge-only cadence of discovery."""
    n = F.json_array_length("parents")
    return table(s, d, "ria_commit").dropDuplicates(["repository_id", "sha"]).where((n > 1) | (n == 0)).select("repository_id", "sha", (n > 1).alias("is_merge"))


@query("w14_recent_events", "with sn as (select user_id as key, ts, row_number() over (partition by user_id order by ts desc) r from events where event_type = 'purchase'), since as (select key, min(ts) as since from sn where r <= 5 group by key) select user_id as key, count(*) as events from events join since on key = user_id where ts >= since group by 1")
def w14_recent_events(s: SparkSession, d: str) -> DataFrame:
    """Events since the oldest of the newest five snapshots of each key."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_type")
    return history.last_n_as_of(e.where("event_type = 'purchase'").select("key", "at"), e).groupBy("key").agg(F.count(F.lit(1)).alias("events"))


@query("w15_as_of", "with p as (select user_id as key, ts, value from events where event_type = 'purchase'), c as (select event_id, user_id as key, ts from events where event_type = 'click') select c.key, c.ts as at, p.value from c asof left join p on c.key = p.key and c.ts >= p.ts")
def w15_as_of(s: SparkSession, d: str) -> DataFrame:
    """The last purchase value at each click, an as-of join by one window."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_type", "value")
    return history.as_of(e.where("event_type = 'click'").select("key", "at"), e.where("event_type = 'purchase'"), "value")


# ---------------------------------------------------------------- differences

def _manifests(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text")
    old = docs.where("doc_id % 10 <> 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 11 <> 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2(F.when(F.expr("doc_id % 13 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


@query("u01_manifest_diff", """with o as (select lpad(doc_id::varchar, 12, '0') as path, sha256(text) as h from documents where text is not null and doc_id % 10 <> 0),
n as (select lpad(doc_id::varchar, 12, '0') as path, sha256(case when doc_id % 13 = 0 then text || '!' else text end) as h from documents where text is not null and doc_id % 11 <> 0),
b as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' when o.h = n.h then 'unchanged' else 'modified' end as change, coalesce(n.h, o.h) as h from o full join n on o.path = n.path),
m as (select *, row_number() over (partition by change, h order by path) as k from b where change in ('added', 'deleted')),
r as (select h, k, max(path) filter (change = 'added') as t, max(path) filter (change = 'deleted') as f from m group by all)
select change, path, null::varchar as old_path from b where change in ('modified', 'unchanged')
union all select case when t is not null and f is not null then 'renamed' when f is null then 'added' else 'deleted' end, coalesce(t, f), case when t is not null then f end from r""")
def u01_manifest_diff(s: SparkSession, d: str) -> DataFrame:
    """Added, modified, deleted, unchanged and renamed files."""
    return diff.manifest_diff(*_manifests(s, d))


@query("u09_first_texts", "select doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as key from (select *, row_number() over (partition by md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) order by doc_id) r from documents where text is not null) where r = 1")
def u09_first_texts(s: SparkSession, d: str) -> DataFrame:
    """The first document of each distinct text."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", diff.text_key(F.col("text")).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query("u04_degree_delta", "with o as (select distinct l_partkey as src, l_suppkey + 1000000 as dst from lineitem where l_linenumber <= 3), n as (select distinct l_partkey as src, l_suppkey + 1000000 as dst from lineitem where l_linenumber >= 2), dg as (select node, sum(o)::bigint as before, sum(n)::bigint as after from (select unnest([src, dst]) as node, 1 as o, 0 as n from o union all select unnest([src, dst]), 0, 1 from n) group by node) select node, before, after, after - before as delta from dg where before <> after")
def u04_degree_delta(s: SparkSession, d: str) -> DataFrame:
    """Nodes whose degree changed between two versions of a graph."""
    e = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"), "l_linenumber")
    return diff.degree_delta(e.where("l_linenumber <= 3"), e.where("l_linenumber >= 2"))


@query("u04_edge_delta", "with o as (select distinct l_partkey as src, l_suppkey as dst from lineitem where l_linenumber <= 3), n as (select distinct l_partkey as src, l_suppkey as dst from lineitem where l_linenumber >= 2) select 'removed' as side, * from (select * from o except select * from n) union all select 'added', * from (select * from n except select * from o)")
def u04_edge_delta(s: SparkSession, d: str) -> DataFrame:
    """Edges only one of two versions has."""
    e = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return diff.graph_delta(e.where("l_linenumber <= 3"), e.where("l_linenumber >= 2"))


def _surface(s: SparkSession, d: str, newer: bool) -> DataFrame:
    p = table(s, d, "part")
    if newer:
        p = p.where("p_partkey % 7 <> 0")
        size, brand = F.when(F.expr("p_partkey % 5 = 0"), F.col("p_size") + 1).otherwise(F.col("p_size")), F.when(F.expr("p_partkey % 11 = 0"), F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand"))
        visible = F.when(F.expr("p_partkey % 17 = 0"), "PRIVATE").otherwise("PUBLIC")
    else:
        p = p.where("p_partkey % 3 <> 0")
        size, brand, visible = F.col("p_size"), F.col("p_brand"), F.lit("PUBLIC")
    return p.select(brand.alias("file_path"), F.concat_ws(".", F.col("p_type"), F.col("p_partkey")).alias("qualified"), F.concat("p_name", F.lit("_"), "p_partkey").alias("name"), visible.alias("visibility"), size.alias("param_count"))


@query("u03_api_diff", """with b as (select p_brand as f, p_type || '.' || p_partkey as q, p_name || '_' || p_partkey as name, p_size as pc from part where p_partkey % 3 <> 0),
a0 as (select case when p_partkey % 11 = 0 then p_brand || 'x' else p_brand end as f, p_type || '.' || p_partkey as q, p_name || '_' || p_partkey as name, case when p_partkey % 17 = 0 then 'PRIVATE' else 'PUBLIC' end as v, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as pc from part where p_partkey % 7 <> 0),
a as (select * from a0 where v = 'PUBLIC'), rem as (select * from b anti join a using (f, q)), ad as (select * from a anti join b using (f, q)), mv as (select * from rem semi join ad using (name))
select 'moved' as kind, name, f as file_path, 'medium' as severity from mv union all select 'removed', name, f, 'high' from (select * from rem anti join mv using (f, q))
union all select 'signature_changed', b.name, b.f, 'high' from b join a using (f, q) where b.pc > 0 and b.pc <> a.pc union all select 'visibility_reduced', name, f, 'high' from b semi join (select * from a0 where v = 'PRIVATE') using (f, q)""")
def u03_api_diff(s: SparkSession, d: str) -> DataFrame:
    """Breaking changes between two public surfaces."""
    return diff.api_diff(_surface(s, d, False), _surface(s, d, True))


@query("u14_conflicts", "with e as (select o_orderkey as id, 'c' || o_custkey as cause from orders), m as (select cause, count(*) as members from e group by 1 having count(*) > 1) select id, 'file_collision' as conflict, cause, members from e join m using (cause) union all select o_orderkey, 'module_ownership', 'security', (select count(*) from orders where o_orderstatus = 'F') from orders where o_orderstatus = 'F' and o_orderkey not in (select id from e join m using (cause))")
def u14_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Recommendations that touch others, by cause."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "security").otherwise("other").alias("category"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("entities"))
    return diff.conflicts(o)


@query("u11_fuzzy_merge", None)
def u11_fuzzy_merge(s: SparkSession, d: str) -> DataFrame:
    """Similar task descriptions of one repository merged."""
    t = table(s, d, "impact_tasks").select(F.col("repository").alias("category"), F.xxhash64("task_id").alias("ord"), F.col("change_description").alias("text"), F.lit(2).alias("severity"), F.lit(0.5).alias("confidence"))
    return diff.fuzzy_merge(t)


# ---------------------------------------------------------------- findings and scores

def _findings(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), "o_custkey", severity.alias("severity"), F.col("o_orderstatus").alias("category"), F.round(F.expr("(o_orderkey % 100) / 1000.0"), 3).cast("double").alias("confidence"))


_F = "f as (select o_orderkey as id, o_custkey, ['critical','high','medium','low','info'][substr(o_orderpriority, 1, 1)::int] as severity, o_orderstatus as category, round((o_orderkey % 100) / 1000.0, 3)::double as confidence from orders)"


@query("a15_deductions", f"with {_F} select o_custkey, count(*) as findings, greatest(0, round(100 - sum(case severity when 'critical' then 15 when 'high' then 8 when 'medium' then 4 when 'low' then 2 else 0.5 end * confidence), 1))::double as score from f group by 1")
def a15_deductions(s: SparkSession, d: str) -> DataFrame:
    """Weighted deduction of findings for each owner."""
    return scoring.deduction(_findings(s, d), ["o_custkey"])


@query("a16_severity_counts", f"with {_F} select severity, category, count(*) as findings from f group by grouping sets ((severity), (category), ())")
def a16_severity_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts by severity, by category and in all."""
    return scoring.severity_counts(_findings(s, d))


@query("a12_module_metrics", None)
def a12_module_metrics(s: SparkSession, d: str) -> DataFrame:
    """Lines, complexity, maintainability and comment density of every body."""
    b = table(s, d, "source_files").where("content is not null").select(F.concat_ws("@", "repository_id", "content_hash").alias("path"), "content", F.lit(0).alias("fan_in"), F.lit(0).alias("fan_out"))
    return scoring.module_metrics(b)


@query("a23_precision_recall", "with p as (select distinct o_orderstatus as g, o_custkey as k from orders where o_totalprice > 200000), t as (select distinct o_orderstatus as g, o_custkey as k from orders where o_orderpriority in ('1-URGENT', '2-HIGH')), c as (select coalesce(p.g, t.g) as g, count(*) filter (p.k is not null and t.k is not null) as tp, count(*) filter (t.k is null) as fp, count(*) filter (p.k is null) as fn from p full join t on p.g = t.g and p.k = t.k group by 1) select g, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c")
def a23_precision_recall(s: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of a prediction for each group."""
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_custkey").alias("k"), "o_totalprice", "o_orderpriority")
    out = scoring.precision_recall(o.where("o_totalprice > 200000"), o.where("o_orderpriority in ('1-URGENT', '2-HIGH')"), ["k"], ["g"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a25_coverage", "select language, count(*) as files, sum(line_count)::bigint as loc, round(100.0 * sum(line_count) / sum(sum(line_count)) over (), 6) as percent from (select * from (select *, row_number() over (partition by repository_id, commit_sha, path order by delivered_at desc) rn from ria_file_unit) where rn = 1) group by language having sum(line_count) is not null")
def a25_coverage(s: SparkSession, d: str) -> DataFrame:
    """Files and lines by language with their share."""
    units = table(s, d, "ria_file_unit").groupBy("repository_id", "commit_sha", "path").agg(F.max(F.struct("delivered_at", "language", "line_count")).alias("r"))
    by = units.groupBy(F.col("r.language").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("r.line_count").alias("loc")).where("loc is not null")
    return by.withColumn("percent", F.round(100.0 * F.col("loc") / F.sum("loc").over(Window.partitionBy()), 6))


@query("r02_impact_risk", "with c as (select o_custkey as k, count(*) as n, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderpriority = '1-URGENT') as u from orders group by 1), p as (select k, n, f, case when n >= 15 then 4 when n >= 6 then 2 when n >= 3 then 1 else 0 end + case when f >= 8 then 3 when f >= 3 then 2 when f >= 1 then 1 else 0 end + case when u >= 4 then 4 when u >= 1 then 2 else 0 end + case when u >= 2 then 2 when u >= 1 then 1 else 0 end + least(f, 3) as points from c) select k, points::bigint as points, case when points >= 10 then 'extreme' when points >= 6 then 'high' when points >= 3 then 'medium' else 'low' end as risk, least(95, 65 + least(2 * n, 20) + least(2 * f, 10))::bigint as confidence, case when n <= 2 then 'XS' when n <= 5 then 'S' when n <= 12 then 'M' when n <= 25 then 'L' else 'XL' end as blast from p")
def r02_impact_risk(s: SparkSession, d: str) -> DataFrame:
    """Points, risk, confidence and blast class of a change from counted facts."""
    c = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("f"), F.count_if(F.expr("o_orderpriority = '1-URGENT'")).alias("u"))
    points, risk = scoring.impact_risk(F.col("n"), F.col("f"), F.col("u"), F.col("u"), F.lit(0), F.col("f"), F.lit(False))
    return c.select("k", points.cast("bigint").alias("points"), risk.alias("risk"), scoring.impact_confidence(F.col("n"), F.col("f"), F.col("n")).alias("confidence"), scoring.blast_class(F.col("n")).alias("blast"))


@query("r05_commit_sizes", "select repository_id, sha, round(s, 6)::double as score, case when s <= 20 then 'XS' when s <= 40 then 'S' when s <= 60 then 'M' when s <= 80 then 'L' else 'XL' end as size from (select *, least(files_changed * 3.0, 30) + least(files_changed * 1.5, 30) + least((insertions + deletions) * 0.1, 40) as s from ria_commit)")
def r05_commit_sizes(s: SparkSession, d: str) -> DataFrame:
    """The size class of every commit."""
    score, size = scoring.pr_size(F.col("files_changed"), F.col("files_changed"), F.col("insertions") + F.col("deletions"))
    return table(s, d, "ria_commit").select("repository_id", "sha", F.round(score, 6).alias("score"), size.alias("size"))


@query("r09_health", """with c as (select repository_id, count(*) as n, count(*) filter (index_state = 'failed') as bad, avg(deletions) / 1000.0 as d, count(*) filter (files_changed > 10) as hot from ria_commit group by 1),
s as (select repository_id, round(100 * exp(-0.1 * (bad + 3.0 * 0 + 0.5 * hot)), 1) as architecture, round(100 * (1 - least(1.0, d)), 1) as api, round(100 * (1 - least(1.0, bad / n)) * exp(-0.03 * hot), 1) as hygiene, round(100 * exp(-5.0 * hot / greatest(1, n)), 1) as churn, round(100 * least(1.0, n / 5.0), 1) as readability from c),
o as (select *, round(0.25 * architecture + 0.2 * api + 0.2 * hygiene + 0.2 * churn + 0.15 * readability, 1) as overall from s)
select repository_id, architecture, api, hygiene, churn, readability, overall, case when overall >= 90 then 'A' when overall >= 80 then 'B' when overall >= 70 then 'C' when overall >= 60 then 'D' else 'F' end as grade from o""")
def r09_health(s: SparkSession, d: str) -> DataFrame:
    """Health scores and grade of each repository from its commits."""
    c = table(s, d, "ria_commit").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("index_state = 'failed'")).alias("bad"), (F.avg("deletions") / 1000.0).alias("d"), F.count_if(F.expr("files_changed > 10")).alias("hot"))
    h = scoring.health(F.col("bad"), F.lit(0), F.col("hot"), F.col("d"), F.col("bad") / F.col("n"), F.col("hot"), F.col("hot"), F.col("n"), F.col("n"))
    return c.select("repository_id", *[v.alias(k) for k, v in h.items()])


@query("r15_large_files", "select repository_id, commit_sha, path, size_bytes from ria_file_unit where size_bytes > 100000")
def r15_large_files(s: SparkSession, d: str) -> DataFrame:
    """Files over 100,000 bytes, the filter pushed into the scan."""
    return table(s, d, "ria_file_unit").where("size_bytes > 100000").select("repository_id", "commit_sha", "path", "size_bytes")


@query("r30_run_analytics", "select event_type, count(*) as runs, round(avg((value > 10)::int), 6) as success_rate, round(avg(value), 6) as mean from events group by 1")
def r30_run_analytics(s: SparkSession, d: str) -> DataFrame:
    """Success rate and mean duration of runs."""
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean"))


@query("w07_priorities", f"with {_F}, p as (select o_custkey as k, count(*) as n, count(distinct category) as e, max(confidence)::double as c from f group by 1) select k, round((20 + 10 + least(5 * (n - 1), 25) + least(2 * e, 20)) * c, 2)::double as score, case when round((30 + least(5 * (n - 1), 25) + least(2 * e, 20)) * c, 2) >= 100 then 'critical' when round((30 + least(5 * (n - 1), 25) + least(2 * e, 20)) * c, 2) >= 60 then 'high' when round((30 + least(5 * (n - 1), 25) + least(2 * e, 20)) * c, 2) >= 30 then 'medium' else 'low' end as label from p")
def w07_priorities(s: SparkSession, d: str) -> DataFrame:
    """Priority score and label of recommendations."""
    p = _findings(s, d).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("e"), F.max("confidence").alias("c"))
    score, label = scoring.priority(F.lit(20), F.lit(10), F.col("n"), F.col("e"), F.col("c"))
    return p.select("k", score.cast("double").alias("score"), label.alias("label"))


# ---------------------------------------------------------------- search and retrieval

def _symbols(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified"), F.col("p_type").alias("kind"), F.col("p_brand").alias("path"))


_KIND = "case when lower(p_name) = 'red' then 'EXACT' when lower(p_brand || '.' || p_name) = 'red' then 'QUALIFIED_NAME' when starts_with(lower(p_name), 'red') then 'PREFIX' when contains(regexp_replace(p_name, '[^A-Z]', '', 'g'), 'RED') then 'CAMEL_CASE' when contains(lower(p_name), 'red') then 'SUBSTRING' when contains(lower(p_name), 'r') and contains(lower(p_name), 'e') and contains(lower(p_name), 'd') then 'FUZZY' when contains(lower(p_brand), 'red') then 'FILE_PATH' end"


@query("w04_search", f"select p_partkey as symbol_id, p_name as name, kind, (map {{'EXACT': 1.0, 'QUALIFIED_NAME': 0.9, 'PREFIX': 0.8, 'CAMEL_CASE': 0.7, 'SUBSTRING': 0.6, 'FUZZY': 0.5, 'FILE_PATH': 0.4}}[kind])::double as score from (select *, {_KIND} as kind from part) where kind is not null order by score desc, symbol_id limit 20")
def w04_search(s: SparkSession, d: str) -> DataFrame:
    """The best matches of a symbol query, a top-k report."""
    return search.rank_symbols(_symbols(s, d), "red")


@query("w10_pick", "select symbol_id, name from (select p_partkey as symbol_id, p_name as name, row_number() over (partition by lower(p_name) order by p_partkey) r from part) where r = 1")
def w10_pick(s: SparkSession, d: str) -> DataFrame:
    """One symbol of each name."""
    return search.pick_by_priority(_symbols(s, d)).select("symbol_id", "name")


@query("v13_autocomplete", "select name, case when starts_with(name, 'bl') then 0.9 else 0.6 end::double as score from (select distinct p_name as name from part) where contains(name, 'bl') order by score desc, name limit 10")
def v13_autocomplete(s: SparkSession, d: str) -> DataFrame:
    """Completions of a prefix, a top-k report."""
    return search.autocomplete(_symbols(s, d), "bl")


@query("v14_highlight", "select p_partkey as symbol_id, regexp_replace(p_name, '(red)', '[\\1]', 'gi') as name from part")
def v14_highlight(s: SparkSession, d: str) -> DataFrame:
    """Matches of a query in brackets."""
    return _symbols(s, d).select("symbol_id", search.highlighted(F.col("name"), "red").alias("name"))


_EACH = "with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0), r as (select query_id, vec_id, {} as distance from embeddings, q) select * from r qualify row_number() over (partition by query_id order by distance, vec_id) <= 10"


@query("v02_nearest", _EACH.format("greatest(0, round(1 - list_cosine_similarity(embedding::double[], q), 4))::double"))
def v02_nearest(s: SparkSession, d: str) -> DataFrame:
    """The 10 vectors nearest to every vector with an id divisible by 50, by cosine."""
    v = table(s, d, "embeddings")
    return search.nearest_each(v, v.where("vec_id % 50 = 0"))


@query("v03_nearest_l2", _EACH.format("round(list_sum(list_transform(list_zip(embedding::double[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"))
def v03_nearest_l2(s: SparkSession, d: str) -> DataFrame:
    """The same by squared distance."""
    v = table(s, d, "embeddings")
    return search.nearest_each(v, v.where("vec_id % 50 = 0"), squared=True)


@query("v07_hybrid", None)
def v07_hybrid(s: SparkSession, d: str) -> DataFrame:
    """Best documents for a question by class, distance and overlap, a top-k report."""
    docs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/d.py")).alias("path"), F.col("text").alias("content"), (F.expr("doc_id % 97") / 100.0).alias("distance"))
    return search.hybrid_rank(docs, "which files does the frozen scanner change")


_B = "i as (select o_custkey as grp, o_orderkey as id, round(o_totalprice / 1000)::bigint as tokens, o_totalprice as weight from orders)"


@query("v23_prefix_budget", f"with {_B} select grp, id from (select *, sum(tokens) over (partition by grp order by weight desc, id rows unbounded preceding) as used from i) where used <= 500")
def v23_prefix_budget(s: SparkSession, d: str) -> DataFrame:
    """Context items by weight until the first overflow."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000).cast("bigint").alias("tokens"), F.col("o_totalprice").alias("weight"))
    return search.prefix_budget(o, 500).select("grp", "id")


@query("v22_greedy_budget", None)
def v22_greedy_budget(s: SparkSession, d: str) -> DataFrame:
    """Greedy fill of a token budget, passing over what does not fit."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000).cast("bigint").alias("tokens"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return search.greedy_budget(o, 500)


@query("v25_chunk_caps", """with c as (select o_orderstatus as grp, 'f' || (o_custkey % 50) as path, o_orderkey as id, o_totalprice as score from orders),
a as (select *, row_number() over (partition by grp, path order by score desc, id) n from c), b as (select *, max(score) over (partition by grp, path) as top from a where n <= 3),
f as (select *, dense_rank() over (partition by grp order by top desc, path) as fr from b), t as (select *, row_number() over (partition by grp order by score desc, id) as tr from f where fr <= 10) select grp, path, id from t where tr <= 20""")
def v25_chunk_caps(s: SparkSession, d: str) -> DataFrame:
    """Caps on files, chunks of a file and chunks in all, the feature itself."""
    c = table(s, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.expr("concat('f', o_custkey % 50)").alias("path"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return search.chunk_caps(c, 10, 3, 20).select("grp", "path", "id")


@query("v26_citations", None)
def v26_citations(s: SparkSession, d: str) -> DataFrame:
    """Citations of path:line in documents, checked against the files."""
    answers = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("answer_id"), F.regexp_replace("text", r"(?:Line|Zeile|ligne|línea) (\d+) (?:of|in|de) ([\w./-]+)", "$2:$1").alias("text"))
    return search.citations(answers, table(s, d, "ria_file_unit").select("path", "line_count"))


@query("a27_best_chunk", "select 'l' || label as path, round(max(1 / (1 + (vec_id % 100) / 100.0)), 3) as score from embeddings group by 1 order by score desc, path limit 10")
def a27_best_chunk(s: SparkSession, d: str) -> DataFrame:
    """The best chunk of each file, a top-k report."""
    v = table(s, d, "embeddings").select(F.concat(F.lit("l"), "label").alias("path"), (F.expr("vec_id % 100") / 100.0).alias("distance"))
    return search.best_chunk(v)


@query("w16_keyword_files", None)
def w16_keyword_files(s: SparkSession, d: str) -> DataFrame:
    """Files by keywords of a question, a top-k report."""
    return search.keyword_files(_paths(s, d), ["scanner", "token", "frozen"])


@query("w17_page", "select p_partkey, p_name from part order by p_partkey limit 25 offset 50")
def w17_page(s: SparkSession, d: str) -> DataFrame:
    """One page of a listing, the feature itself."""
    return search.page(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", 25, 50)


QUERIES, ORACLES = _Q, _O
