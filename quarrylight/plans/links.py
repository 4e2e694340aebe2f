"""Queries over facts whose links are known: every part is a source file that imports, calls and inherits by rule.

The bodies of the given tables name no file of their own repository, so these
queries make facts of the parts' keys: file k imports file 7k, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import context, resolve
from quarrylight.sources import files as source_files
from quarrylight.sources.parse import FACTS
from quarrylight.storage import materialize, table

_Q: dict = {}
_O: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql:
            _O[name] = sql
        return f

    return keep


_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def _fact(k: DataFrame, **given: str) -> DataFrame:
    """Facts of files k by expressions; lines default to 1."""
    usual = {"g": "'r'", "fact": "'symbol'", "kind": "'function'", "name": "''", "parent": "cast(null as string)", "start": "1", "end": "1", "detail": "''", "path": "path"}
    return k.select(*[F.expr(f"{ {**usual, **given}[c] }").alias(c) for c in _COLUMNS])


#: Two of three files are Python modules, the third is a script. t is what a file links to.
_KEYS = "select p_partkey as k, p_partkey * 7 % 2600 as t, case when p_partkey % 3 < 2 then 'src/pkg' || (p_partkey % 10) || '/m' || p_partkey || '.py' else 'web/c' || (p_partkey % 10) || '/f' || p_partkey || '.ts' end as path from part"
_KEYS_SQL = f"k as materialized ({_KEYS}), py as (select * from k where k % 3 < 2), ts as (select * from k where k % 3 = 2)"


def _files(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(s, d, "part").selectExpr("p_partkey as k", "p_partkey * 7 % 2600 as t").selectExpr("*", "case when k % 3 < 2 then concat('src/pkg', k % 10, '/m', k, '.py') else concat('web/c', k % 10, '/f', k, '.ts') end as path")
    return p, p.where("k % 3 < 2"), p.where("k % 3 = 2")


def _imports(s: SparkSession, d: str) -> DataFrame:
    """Python: the module by its dotted name (line 1) and a function by a relative import (line 2); scripts: a relative path (line 1)."""
    _, py, ts = _files(s, d)
    whole = _fact(py, fact="'import'", kind="'module'", name="concat('m', t)", detail="concat('pkg', t % 10, '.m', t)")
    part = _fact(py, fact="'import'", kind="'symbol'", name="concat('alias', t)", detail="concat('..pkg', t % 10, '.m', t, ':f', t)", start="2")
    near = _fact(ts, fact="'import'", kind="'module'", name="'x'", detail="concat('../c', t % 10, '/f', t)")
    return whole.unionByName(part).unionByName(near)


@query("j03_linked_files", f"with {_KEYS_SQL} select distinct 'r' as g, a.path as src, b.path as dst from py a join py b on b.k = a.t union select 'r', a.path, b.path from ts a join ts b on b.k = a.t")
def j03_linked_files(s: SparkSession, d: str) -> DataFrame:
    """Dependencies between files by dotted, relative and path imports; imports of files that are not there lead nowhere."""
    k, _, _ = _files(s, d)
    return resolve.file_edges(_imports(s, d), k.select(F.lit("r").alias("g"), "path"))


@query("j04_linked_modules", f"with {_KEYS_SQL} select distinct 'r' as g, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') as src, 'pkg' || (t % 10) as dst from py union select distinct 'r', replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.'), '..pkg' || (t % 10) from py union select distinct 'r', replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.'), '..' from ts")
def j04_linked_modules(s: SparkSession, d: str) -> DataFrame:
    """Dependencies between modules by the top of what they import."""
    return resolve.module_edges(_imports(s, d))


@query("j22_imported_symbols", f"with {_KEYS_SQL} select 'r' as g, a.path, 2 as line, 'alias' || a.t as name, b.path as target, case when b.k % 2 = 0 then 'f' || b.k end as symbol from py a join py b on b.k = a.t union all select 'r', a.path, 1, 'm' || a.t, b.path, null from py a join py b on b.k = a.t union all select 'r', a.path, 1, 'x', b.path, null from ts a join ts b on b.k = a.t")
def j22_imported_symbols(s: SparkSession, d: str) -> DataFrame:
    """What each import names, and its symbol where the file has it (here every second one)."""
    k, py, _ = _files(s, d)
    symbols = py.where("k % 2 = 0").selectExpr("'r' as g", "path", "concat('f', k) as name")
    return resolve.import_symbols(_imports(s, d), k.select(F.lit("r").alias("g"), "path"), symbols)


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Symbols f<k> and class C<k> with methods m and n in every Python file, and five calls."""
    _, py, _ = _files(s, d)
    parts = [
        _imports(s, d),
        _fact(py, name="concat('f', k)", start="10", end="20"),
        _fact(py, kind="'class'", name="concat('C', k)", start="30", end="60"),
        _fact(py, kind="'method'", name="'m'", parent="concat('C', k)", start="31", end="40"),
        _fact(py, kind="'method'", name="'n'", parent="concat('C', k)", start="41", end="50"),
        _fact(py, fact="'call'", kind="''", name="'n'", parent="concat('C', k, '.m')", start="32", end="32", detail="'self'"),
        _fact(py, fact="'call'", kind="''", name="concat('alias', t)", parent="concat('f', k)", start="11", end="11"),
        _fact(py, fact="'call'", kind="''", name="concat('f', t)", parent="concat('f', k)", start="12", end="12", detail="concat('m', t)"),
        _fact(py, fact="'call'", kind="''", name="concat('f', k)", parent="concat('f', k)", start="13", end="13"),
        _fact(py, fact="'call'", kind="''", name="concat('f', (k * 11) % 2600)", parent="concat('f', k)", start="14", end="14"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("j05_linked_calls", f"""with {_KEYS_SQL}, c as (
  select path, 32 as line, 'C' || k || '.m' as caller, 'n' as callee, path as target_path, 'C' || k || '.n' as target, 'own_class' as tier from py
  union all select a.path, 11, 'f' || a.k, 'alias' || a.t, b.path, 'f' || b.k, case when b.k is not null then 'import_symbol' end from py a left join py b on b.k = a.t
  union all select a.path, 12, 'f' || a.k, 'f' || a.t, b.path, 'f' || b.k, case when b.k is not null then 'import_module' end from py a left join py b on b.k = a.t
  union all select path, 13, 'f' || k, 'f' || k, path, 'f' || k, 'same_file' from py
  union all select a.path, 14, 'f' || a.k, 'f' || (a.k * 11) % 2600, b.path, 'f' || b.k, case when b.k = a.k then 'same_file' when b.k is not null then 'unique' end from py a left join py b on b.k = (a.k * 11) % 2600)
  select 'r' as g, *, case when tier is null then 'LOW' else 'HIGH' end as confidence from c""")
def j05_linked_calls(s: SparkSession, d: str) -> DataFrame:
    """Every call with what it resolves to, by tier."""
    k, _, _ = _files(s, d)
    return resolve.resolve_calls(_calls(s, d), k.select(F.lit("r").alias("g"), "path"))


@query("j07_innermost", f"with {_KEYS_SQL} select path, l.l as at, case when l.l between 31 and 40 then 'C' || k || '.m' when l.l between 41 and 50 then 'C' || k || '.n' when l.l between 30 and 60 then 'C' || k when l.l between 10 and 20 then 'f' || k end as scope from py, (select unnest([5, 10, 15, 20, 25, 30, 31, 40, 45, 55, 60, 61]) as l) l")
def j07_innermost(s: SparkSession, d: str) -> DataFrame:
    """The innermost symbol around lines of every file."""
    f, (_, py, _) = _calls(s, d), _files(s, d)
    scopes = f.where("fact = 'symbol'").select("g", "path", "start", "end", F.concat_ws(".", "parent", "name").alias("scope"))
    points = py.select(F.lit("r").alias("g"), "path", F.explode(F.array(*[F.lit(x) for x in (5, 10, 15, 20, 25, 30, 31, 40, 45, 55, 60, 61)])).alias("at"), F.col("k").alias("id"))
    points = points.withColumn("id", F.col("id") * 100 + F.col("at"))
    return resolve.enclosing_scopes(points, scopes).select("path", "at", "scope")


@query("j09_bases", "with recursive c as (select p_partkey as k, p_partkey // 2 as b from part where p_partkey > 0), up as (select k, k as a, 0 as distance from c union all select up.k, c.b, up.distance + 1 from up join c on c.k = up.a where exists (select 1 from c x where x.k = c.b)), m as (select k, 'm' || (k % 4) as method from c where k < 500), h as (select up.k, m.method, up.a, up.distance, row_number() over (partition by up.k, m.method order by up.distance) as r from up join m on m.k = up.a) select 'C' || k as class, method, 'C' || a as from_class, distance from h where r = 1")
def j09_bases(s: SparkSession, d: str) -> DataFrame:
    """The definition each class uses for a method, over ten and more levels of bases."""
    k = table(s, d, "part").where("p_partkey > 0").selectExpr("p_partkey as k", "concat('a', p_partkey % 7, '.py') as path")
    cls = _fact(k, kind="'class'", name="concat('C', k)")
    base = _fact(k, fact="'base'", kind="'class'", name="concat('C', k)", detail="concat('mod.C', k div 2)")
    method = _fact(k.where("k < 500"), kind="'method'", name="concat('m', k % 4)", parent="concat('C', k)")
    return resolve.inherited_methods(cls.unionByName(base).unionByName(method)).select("class", "method", "from_class", "distance")


@query("j23_overrides", "with c as (select p_partkey as k, p_partkey // 2 as b, 'm' || (p_partkey % 4) as method from part where p_partkey > 0) select 'C' || x.k as cls, 'C' || y.k as base, x.method from c x join c y on y.k = x.b and y.method = x.method")
def j23_overrides(s: SparkSession, d: str) -> DataFrame:
    """Methods that a class and its base both define."""
    k = table(s, d, "part").where("p_partkey > 0").selectExpr("p_partkey as k", "'a.py' as path")
    base = _fact(k, fact="'base'", kind="'class'", name="concat('C', k)", detail="concat('mod.C', k div 2)")
    return resolve.overrides(base.unionByName(_fact(k, kind="'method'", name="concat('m', k % 4)", parent="concat('C', k)"))).select("cls", "base", "method")


@query("j17_linked_tests", f"with {_KEYS_SQL}, changed as (select k, path from py where k % 50 = 0), h as (select a.k, 1.0 as score from py a join changed c on a.t = c.k union all select a.k, 0.95 from py a join changed c on (a.k * 11) % 2600 = c.k union all select a.k, 0.7 from py a join changed c on (a.k * 13) % 2600 = c.k), b as (select k, max(score)::double as score from h group by 1) select 'r' as g, 'tests/test_' || k || '.py' as test, score, case when score >= 0.85 then 'HIGH' else 'MEDIUM' end as tier from b")
def j17_linked_tests(s: SparkSession, d: str) -> DataFrame:
    """Tests by the facts they share with changed files: a call, an imported symbol, an imported module."""
    _, py, _ = _files(s, d)
    changed = py.where("k % 50 = 0").selectExpr("'r' as g", "path", "concat('f', k) as name")
    t = py.withColumn("path", F.concat(F.lit("tests/test_"), F.col("k"), F.lit(".py")))
    calls = _fact(t, fact="'call'", name="concat('f', t)")
    symbol = _fact(t, fact="'import'", kind="'symbol'", name="'x'", detail="concat('any:f', (k * 11) % 2600)")
    module = _fact(t, fact="'import'", kind="'module'", name="'y'", detail="concat('src.pkg', (k * 13) % 2600 % 10, '.m', (k * 13) % 2600)")
    return resolve.test_evidence(calls.unionByName(symbol).unionByName(module), changed)


@query("p18_linked_words", f"with {_KEYS_SQL} select 'r' as g, a.path, 'f' || b.k as name from py a join py b on b.k = a.t union select 'r', path, 'f' || k from py")
def p18_linked_words(s: SparkSession, d: str) -> DataFrame:
    """Files that mention a symbol as a whole word (f1 is none of f10's)."""
    _, py, _ = _files(s, d)
    files = py.selectExpr("'r' as g", "path", "concat('def f', k, '(a): return pkg.f', t, '(a) + f', k, '_x') as content")
    return context.references_symbol(files, py.selectExpr("'r' as g", "concat('f', k) as name"))


@query("p05_ruled_symbols", """with x as (select p_partkey as k, case p_partkey % 6 when 0 then 'src/a.py' when 1 then 'src/a.ts' when 2 then 'x/tests/a.go' when 3 then 'x/internal/a.py' when 4 then 'x/api/a.go' else 'lib/a.go' end as path,
  case p_partkey % 5 when 0 then '_f' when 1 then '__f' when 2 then 'main' else 'f' end as name, case p_partkey % 4 when 0 then 'class' when 1 then 'method' when 2 then 'interface' else 'function' end as kind, p_partkey % 4 = 1 as inner_,
  p_partkey % 11 = 0 as entry, p_partkey % 3 = 0 as guard, p_partkey % 13 = 0 as route, p_partkey % 17 = 0 as cli, p_partkey % 19 = 0 as express, p_partkey % 7 = 0 as exported, p_partkey % 2 as exports from part),
 y as (select *, ends_with(path, '.py') as py, ends_with(path, '.ts') as ts from x),
 z as (select k, kind, p_partkey_rule.n as rule from (select *, case when entry then 1 when py and name = 'main' and guard then 2 when py and route then 3 when ts and express then 4 when py and cli then 5 when ts and exported then 6 when py and exported then 7
   when py and regexp_matches(name, '^__[^_]') then 8 when py and regexp_matches(name, '^_[^_]') then 9 when ts and exports = 0 then 10 when contains(path, '/test') then 11 when contains(path, '/internal/') then 12 when contains(path, '/api/') then 13
   when ts and kind = 'interface' then 14 when py and kind in ('function', 'class') and not inner_ then 15 when kind = 'method' and inner_ then 16 else 17 end as n from y) p_partkey_rule)
 select k, rule, case when rule in (1, 2, 3, 4, 5, 6, 7, 13, 14, 15) then 'PUBLIC' when rule in (8, 12) then 'PRIVATE' when rule = 17 then 'UNKNOWN' else 'INTERNAL' end as visibility,
  [0.95, 0.90, 0.95, 0.88, 0.90, 0.95, 0.95, 0.90, 0.88, 0.70, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.0][rule]::double as confidence,
  case when rule in (1, 2, 3, 4, 5, 6, 7, 13, 14, 15) and k % 23 = 0 and kind in ('function', 'method', 'class') then true else false end as is_orphan from z""")
def p05_ruled_symbols(s: SparkSession, d: str) -> DataFrame:
    """Symbols made for all seventeen rules of visibility."""
    x = table(s, d, "part").selectExpr(
        "p_partkey as k", "'r' as g", "case p_partkey % 6 when 0 then 'src/a.py' when 1 then 'src/a.ts' when 2 then 'x/tests/a.go' when 3 then 'x/internal/a.py' when 4 then 'x/api/a.go' else 'lib/a.go' end as path",
        "case p_partkey % 5 when 0 then '_f' when 1 then '__f' when 2 then 'main' else 'f' end as name", "case p_partkey % 4 when 0 then 'class' when 1 then 'method' when 2 then 'interface' else 'function' end as kind",
        "case when p_partkey % 4 = 1 then 'A' end as parent", "p_partkey % 11 = 0 as entry", "p_partkey % 3 = 0 as main_guard", "concat_ws(' ', case when p_partkey % 13 = 0 then 'app.get' end, case when p_partkey % 17 = 0 then 'cli.command' end) as decorators",
        "case when p_partkey % 19 = 0 then 'router.post(x)' end as nearby", "p_partkey % 7 = 0 as exported", "cast(p_partkey % 2 as int) as exports", "cast(p_partkey % 23 as bigint) as fan_in",
    )
    return resolve.visibility(x).select("k", "rule", "visibility", "confidence", "is_orphan")


@query("s20_linked_entries", "with f as (select p_partkey as k, case p_partkey % 4 when 0 then 'a' || p_partkey || '/package.json' when 1 then 'a' || (p_partkey - 1) || '/src/start.js' when 2 then 'b' || p_partkey || '/main.py' else 'b' || p_partkey || '/util.py' end as path from part where p_partkey > 0) select b.path, 'manifest' as reason, 1 as priority from f a join f b on a.k % 4 = 0 and b.k = a.k + 1 union all select path, 'main', 2 from f where k % 4 = 2")
def s20_linked_entries(s: SparkSession, d: str) -> DataFrame:
    """Entry points by manifest and by name."""
    f = table(s, d, "part").where("p_partkey > 0").selectExpr(
        "case p_partkey % 4 when 0 then concat('a', p_partkey, '/package.json') when 1 then concat('a', p_partkey - 1, '/src/start.js') when 2 then concat('b', p_partkey, '/main.py') else concat('b', p_partkey, '/util.py') end as path",
        "case when p_partkey % 4 = 0 then '{\"main\": \"./src/start.js\"}' else '' end as content",
    )
    return source_files.entry_points(materialize(f, "files"))


QUERIES, ORACLES = _Q, _O
