"""Joins that resolve imports, calls, names and scopes.

Each tier of a resolution is one equal join; a single ranking window picks the
best tier, ties by path and line, so results never depend on row order.
Facts are rows of :data:`quarrylight.sources.parse.FACTS`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import paths
from quarrylight.operators.graph import Seen
from quarrylight.storage import materialize, rows_of


def normalised(path: Column) -> Column:
    """A path without dot parts; each ``..`` takes back the part before it."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(fold, "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """(g, path, line, name, pos, candidate): where an import may lead, in order of precedence."""
    target = F.when(F.col("kind") == "symbol", F.regexp_extract("detail", r"^(.*):[^:]*$", 1)).otherwise(F.col("detail"))
    rows = imports.where("fact = 'import'").withColumn("target", target).withColumn("dir", paths.directory(F.col("path")))
    script = paths.extension(F.lower("path")).isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise(F.lit(""))
    rel = F.translate(F.regexp_replace("target", r"^\.+", ""), ".", "/")
    here = normalised(F.concat_ws("/", "dir", F.concat(up, rel)))
    python = F.when(dots > 0, F.array(F.concat(here, F.lit(".py")), F.concat(here, F.lit("/__init__.py")))).otherwise(
        F.array(*[F.regexp_replace(F.concat(pre, rel, F.lit(end)), "^/+", "") for pre in (F.lit(""), F.concat("dir", F.lit("/")), F.lit("src/")) for end in (".py", "/__init__.py")])
    )
    base = normalised(F.concat_ws("/", "dir", "target"))
    tails = F.array(*[F.concat(base, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")])
    js = F.when(~F.col("target").startswith("."), F.array().cast("array<string>")).when(F.element_at(F.split("target", "/"), -1).contains("."), F.concat(F.array(base), tails)).otherwise(tails)
    return rows.select("g", "path", F.col("start").alias("line"), "name", F.posexplode(F.when(script, js).otherwise(python)).alias("pos", "candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(g, path, line, name, target): the first candidate that is a file; external imports are left out."""
    known = files.select("g", F.col("path").alias("candidate")).distinct()
    hit = import_candidates(imports).join(known, ["g", "candidate"])
    return hit.groupBy("g", "path", "line", "name").agg(F.min_by("candidate", "pos").alias("target"))


def import_symbols(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(g, path, line, name, target, symbol) of imports in all languages at once: the imported symbol of the resolved file, null where it has none of that name.

    symbols: (g, path, name) of definitions at the top of files.
    """
    found = resolve_imports(imports, files)
    original = imports.where("fact = 'import' and kind = 'symbol'").select("g", "path", F.col("start").alias("line"), "name", F.regexp_extract("detail", r":([^:]*)$", 1).alias("symbol"))
    known = symbols.select("g", F.col("path").alias("target"), F.col("name").alias("symbol"), F.lit(True).alias("known")).distinct()
    out = found.join(original, ["g", "path", "line", "name"], "left").join(known, ["g", "target", "symbol"], "left")
    return out.select("g", "path", "line", "name", "target", F.when(F.col("known"), F.col("symbol")).alias("symbol"))


def file_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(g, src, dst) different dependencies between files."""
    return resolve_imports(imports, files).select("g", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def module_edges(imports: DataFrame) -> DataFrame:
    """(g, src, dst) from a file's module to the top-level name of each import, external ones kept."""
    target = F.when(F.col("kind") == "symbol", F.regexp_extract("detail", r"^(.*):[^:]*$", 1)).otherwise(F.col("detail"))
    return imports.where("fact = 'import'").select("g", paths.module_of(F.col("path")).alias("src"), F.regexp_extract(target, r"^(\.*[^./]*)", 1).alias("dst")).where("dst <> ''").distinct()


def enclosing_scopes(points: DataFrame, scopes: DataFrame, block: int = 256) -> DataFrame:
    """For each point (g, path, at, id) the smallest scope (g, path, start, end, scope) that holds it.

    A range join made equal: scopes are listed for each block of lines they
    touch, so a point meets only the scopes of its file and block. Neither side
    is broadcast: lists of points are many times the bytes that they are read from.
    """
    cut = scopes.select("g", "path", "start", "end", "scope", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"end div {block}"))).alias("blk"))
    at = points.withColumn("blk", F.expr(f"at div {block}"))
    hit = at.join(cut.hint("merge"), ["g", "path", "blk"]).where("start <= at and at <= end")
    best = hit.groupBy("g", "path", "id").agg(F.min_by("scope", F.struct(F.col("end") - F.col("start"), F.col("scope"))).alias("scope"))
    return points.join(best.hint("merge"), ["g", "path", "id"], "left")


#: fixed values: tiers of a call's resolution and their confidence
TIERS = ("own_class", "import_symbol", "import_module", "same_file", "unique", "same_directory")


def resolve_calls(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(g, path, line, caller, callee, target_path, target, tier, confidence) of every call.

    In order: a method of the caller's own class by self or this; an imported
    symbol; a member of an imported module; a symbol of the same file; the only
    symbol of that name; one of the same folder, which is ambiguous. A call that no
    tier finds keeps a null target.
    """
    facts = materialize(facts, "facts")
    symbols = facts.where("fact = 'symbol'").select("g", F.col("path").alias("t_path"), F.col("name").alias("t_name"), F.col("parent").alias("t_parent"), "kind", F.col("start").alias("t_line"))
    symbols = symbols.withColumn("target", F.concat_ws(".", "t_parent", "t_name"))
    calls = facts.where("fact = 'call'").select("g", "path", F.col("start").alias("line"), F.coalesce("parent", F.lit("")).alias("caller"), F.col("name").alias("callee"), F.col("detail").alias("receiver")).distinct()
    calls = materialize(calls.withColumn("id", F.monotonically_increasing_id()), "calls")
    alias = materialize(
        facts.where("fact = 'import'")
        .select("g", "path", "kind", F.col("name").alias("alias"), F.when(F.col("kind") == "symbol", F.regexp_extract("detail", r":([^:]*)$", 1)).alias("original"), F.col("start").alias("line"))
        .join(resolve_imports(facts, files).select("g", "path", "line", F.col("name").alias("alias"), F.col("target").alias("file")), ["g", "path", "line", "alias"]),
        "alias",
    )
    flat = symbols.where("t_parent is null")

    def tier(df: DataFrame, n: int) -> DataFrame:
        return df.select("id", F.lit(n).alias("n"), "t_path", "target", "t_line")

    own = calls.where("receiver in ('self', 'cls', 'this') and caller like '%.%'").withColumn("t_parent", F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1))
    own = own.join(symbols.withColumnRenamed("t_path", "path").withColumnRenamed("t_name", "callee"), ["g", "path", "callee", "t_parent"]).withColumn("t_path", F.col("path"))
    plain = calls.where("receiver = ''")
    imported = plain.join(alias.where("kind = 'symbol'").select("g", "path", F.col("alias").alias("callee"), F.col("original").alias("t_name"), F.col("file").alias("t_path")), ["g", "path", "callee"]).join(flat.drop("t_parent"), ["g", "t_path", "t_name"])
    member = calls.where("receiver <> ''").withColumn("alias", F.split("receiver", r"\.")[0])
    member = member.join(alias.where("kind = 'module'").select("g", "path", "alias", F.col("file").alias("t_path")), ["g", "path", "alias"]).join(flat.drop("t_parent").withColumnRenamed("t_name", "callee"), ["g", "t_path", "callee"])
    same = plain.join(flat.drop("t_parent").withColumnRenamed("t_path", "path").withColumnRenamed("t_name", "callee"), ["g", "path", "callee"]).withColumn("t_path", F.col("path"))
    only = flat.groupBy("g", F.col("t_name").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min("t_path").alias("t_path"), F.min("target").alias("target"), F.min("t_line").alias("t_line"))
    unique = plain.join(only.where("n = 1").drop("n"), ["g", "callee"])
    folder = plain.withColumn("dir", paths.directory(F.col("path"))).join(flat.drop("t_parent").withColumn("dir", paths.directory(F.col("t_path"))).withColumnRenamed("t_name", "callee"), ["g", "dir", "callee"])
    every = reduce(DataFrame.unionByName, [tier(x, i) for i, x in enumerate((own, imported, member, same, unique, folder))])
    w = Window.partitionBy("id").orderBy("n", "t_path", "t_line", "target")
    best = every.withColumn("r", F.row_number().over(w)).where("r = 1")
    names = F.array(*[F.lit(t) for t in TIERS])
    out = calls.join(best, "id", "left")
    return out.select(
        "g", "path", "line", "caller", "callee", F.col("t_path").alias("target_path"), "target", F.try_element_at(names, F.col("n") + 1).alias("tier"), F.when(F.col("n").isNull(), "LOW").when(F.col("n") >= 5, "MEDIUM").otherwise("HIGH").alias("confidence")
    )


def inherited_methods(facts: DataFrame) -> DataFrame:
    """(g, path, class, method, from_path, from_class, distance): the nearest definition up the bases, least distance first.

    A base is looked for in the class's own file, else among all classes of its
    name. Bases are followed to the end; a circle of bases ends where it closes.
    """
    classes = facts.where("fact = 'symbol' and kind = 'class'").select("g", "path", F.col("name").alias("cls")).distinct()
    methods = facts.where("fact = 'symbol' and kind = 'method'").select("g", F.col("path").alias("from_path"), F.element_at(F.split("parent", r"\."), -1).alias("from_class"), F.col("name").alias("method")).distinct()
    base = facts.where("fact = 'base'").select("g", "path", F.col("name").alias("cls"), F.element_at(F.split("detail", r"\."), -1).alias("base")).distinct()
    local = base.join(classes.withColumnRenamed("cls", "base").withColumn("b_path", F.col("path")), ["g", "path", "base"])
    other = base.join(local.select("g", "path", "cls", "base"), ["g", "path", "cls", "base"], "left_anti").join(classes.select("g", F.col("cls").alias("base"), F.col("path").alias("b_path")), ["g", "base"])
    up = materialize(local.select("g", "path", "cls", "base", "b_path").unionByName(other.select("g", "path", "cls", "base", "b_path")), "bases")
    level = classes.select("g", "path", "cls", F.col("path").alias("from_path"), F.col("cls").alias("from_class"), F.lit(0).alias("distance"))
    level = materialize(level, "mro")
    seen, k = Seen(["g", "path", "cls", "from_path", "from_class"]), 0
    while rows_of(level):
        seen.add(level)
        k += 1
        step = level.select("g", "path", "cls", F.col("from_path").alias("p"), F.col("from_class").alias("c")).join(up.select("g", F.col("path").alias("p"), F.col("cls").alias("c"), F.col("b_path").alias("from_path"), F.col("base").alias("from_class")), ["g", "p", "c"])
        level = materialize(seen.new(step.select("g", "path", "cls", "from_path", "from_class", F.lit(k).alias("distance")).distinct()), "mro")
    found = (seen.all() if seen.parts else level).join(methods, ["g", "from_path", "from_class"])
    return found.groupBy("g", "path", F.col("cls").alias("class"), "method").agg(F.min(F.struct("distance", "from_path", "from_class")).alias("b")).select("g", "path", "class", "method", "b.from_path", "b.from_class", "b.distance")


def overrides(facts: DataFrame) -> DataFrame:
    """Methods that a class defines and a base defines as well, by name of class and base."""
    m = facts.where("fact = 'symbol' and kind = 'method'").select("g", F.element_at(F.split("parent", r"\."), -1).alias("cls"), F.col("name").alias("method")).distinct()
    b = facts.where("fact = 'base'").select("g", F.col("name").alias("cls"), F.element_at(F.split("detail", r"\."), -1).alias("base")).distinct()
    return b.join(m, ["g", "cls"]).join(m.withColumnRenamed("cls", "base"), ["g", "base", "method"]).select("g", "cls", "base", "method")


def lookup_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(wanted, id, tier): by exact id, else qualified name, else bare name if only one has it."""
    exact = wanted.join(nodes.select(F.col("id").alias("wanted"), "id"), "wanted").select("wanted", "id", F.lit(1).alias("tier"))
    qualified = wanted.join(nodes.select(F.col("qualified").alias("wanted"), "id"), "wanted").select("wanted", "id", F.lit(2).alias("tier"))
    single = nodes.groupBy(F.col("name").alias("wanted")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    bare = wanted.join(single, "wanted").select("wanted", "id", F.lit(3).alias("tier"))
    every = exact.unionByName(qualified).unionByName(bare)
    best = every.groupBy("wanted").agg(F.min("tier").alias("tier"))
    return wanted.join(every.join(best, ["wanted", "tier"]), "wanted", "left")


#: fixed values: parts of a lower-case path by which a symbol is a test helper, private or public
TEST_PARTS = ("/test", "/tests", "/spec", "/specs", "__test__", ".test.", ".spec.")
PRIVATE_PARTS = ("/_internal/", "/internal/", "/private/", "/_private/", "/_helpers/", "/helpers/")
API_PARTS = ("/api/", "/routes/", "/endpoints/", "/controllers/", "/views/", "/handlers/")

VISIBILITY_INPUT = "entry boolean, main_guard boolean, decorators string, nearby string, exported boolean, exports int, fan_in bigint"


def visibility(symbols: DataFrame) -> DataFrame:
    """(.., visibility, api_kind, confidence, rule, is_orphan) of symbols by the first of 17 rules that holds.

    symbols: (g, path, name, kind, parent) and, null where nothing is known, of
    :data:`VISIBILITY_INPUT`: whether the file is an entry point or has a main
    guard, the symbol's decorators, the source lines around it, whether the file
    exports it (in Python by ``__all__``), how many names the file exports (null
    where exports were not read), and its callers. ``rule`` counts from 1.
    """
    low, name, kind = F.lower(F.translate("path", "\\", "/")), F.col("name"), F.col("kind")
    python = low.endswith(".py")
    typed = low.rlike(r"\.tsx?$")
    script = typed | low.rlike(r"\.[cm]?jsx?$")

    def part(of: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(x) for x in of])

    by_kind = lambda cls, other: F.when(kind == "class", cls).otherwise(other)
    exported = F.when(kind == "class", "PUBLIC_CLASS").when(kind == "interface", "INTERFACE").when(kind == "enum", "ENUM_TYPE").otherwise("EXPORTED")
    helper = F.lit("INTERNAL_HELPER")
    rules = [
        (F.col("entry"), "PUBLIC", F.lit("MAIN_ENTRY"), 0.95),
        (python & name.isin("main", "__main__") & F.col("main_guard"), "PUBLIC", F.lit("MAIN_ENTRY"), 0.90),
        (python & F.col("decorators").rlike(r"(?i)\w+\.(get|post|put|patch|delete|head|options|route|websocket)\b"), "PUBLIC", F.lit("ROUTE"), 0.95),
        (script & F.col("nearby").rlike(r"(?i)\b(router|app|express)\s*\.\s*(get|post|put|patch|delete|use|all)\s*\("), "PUBLIC", F.lit("ROUTE"), 0.88),
        (python & F.col("decorators").rlike(r"(?i)\w+\.(command|group)\b"), "PUBLIC", F.lit("CLI_ENTRY"), 0.90),
        (script & F.col("exported"), "PUBLIC", exported, 0.95),
        (python & F.col("exported"), "PUBLIC", by_kind("PUBLIC_CLASS", "PUBLIC_FUNCTION"), 0.95),
        (python & name.rlike("^__[^_]"), "PRIVATE", helper, 0.90),
        (python & name.rlike("^_[^_]"), "INTERNAL", helper, 0.88),
        (script & (F.col("exports") == 0), "INTERNAL", helper, 0.70),
        (part(TEST_PARTS), "INTERNAL", helper, 0.85),
        (part(PRIVATE_PARTS), "PRIVATE", helper, 0.80),
        (part(API_PARTS), "PUBLIC", F.when(kind == "function", "ROUTE").otherwise("PUBLIC_CLASS"), 0.75),
        (typed & kind.isin("interface", "enum"), "PUBLIC", F.when(kind == "interface", "INTERFACE").otherwise("ENUM_TYPE"), 0.70),
        (python & kind.isin("function", "class") & F.col("parent").isNull(), "PUBLIC", by_kind("PUBLIC_CLASS", "PUBLIC_FUNCTION"), 0.65),
        ((kind == "method") & F.col("parent").isNotNull(), "INTERNAL", F.lit("PUBLIC_METHOD"), 0.60),
    ]
    rule = F.coalesce(*[F.when(hit, F.lit(n)) for n, (hit, *_) in enumerate(rules, 1)], F.lit(len(rules) + 1))

    def given(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("rule"))

    rows = symbols.withColumn("rule", rule)
    rows = rows.withColumns({
        "visibility": given([F.lit(v) for _, v, _, _ in rules] + [F.lit("UNKNOWN")]),
        "api_kind": given([k for _, _, k, _ in rules] + [F.lit("UNKNOWN")]),
        "confidence": given([F.lit(c) for *_, c in rules] + [F.lit(0.0)]),
    })
    return rows.withColumn("is_orphan", (F.col("visibility") == "PUBLIC") & (F.coalesce("fan_in", F.lit(0)) == 0) & kind.isin("function", "method", "class"))


#: fixed values: marks of deprecated and of experimental definitions
DEPRECATED = r"(?i)@deprecated|#\s*deprecated|\.\.\s+deprecated::|DeprecationWarning|FutureWarning|deprecated::\s*\d|@obsolete"
EXPERIMENTAL = r"(?i)@experimental|@beta|@alpha|#\s*experimental|experimental::|beta feature|alpha feature"


def lifecycle(around: Column) -> Column:
    """Deprecated, experimental or stable by marks in the lines around a definition."""
    t = F.coalesce(around, F.lit(""))
    return F.when(t.rlike(DEPRECATED), "deprecated").when(t.rlike(EXPERIMENTAL), "experimental").otherwise("stable")


def test_evidence(tests: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, test, score, tier) of test files by the facts they share with changed files (g, path, name).

    tests: facts of test files. A call of a changed symbol counts 1.00, an import of it
    0.95, an import of its file's module 0.70; the best evidence of a test is kept.
    """
    name = targets.select("g", "name").distinct()
    module = targets.select("g", paths.module_of(F.col("path")).alias("module")).distinct()
    calls = tests.where("fact = 'call'").join(name, ["g", "name"]).select("g", "path", F.lit(1.0).alias("score"))
    imported = tests.where("fact = 'import' and kind = 'symbol'").withColumn("name", F.regexp_extract("detail", r":([^:]*)$", 1)).join(name, ["g", "name"]).select("g", "path", F.lit(0.95).alias("score"))
    of = tests.where("fact = 'import'").withColumn("module", F.regexp_extract("detail", r"^([^:]*)", 1)).join(module, ["g", "module"]).select("g", "path", F.lit(0.70).alias("score"))
    best = calls.unionByName(imported).unionByName(of).groupBy("g", F.col("path").alias("test")).agg(F.max("score").alias("score"))
    return best.withColumn("tier", F.when(F.col("score") >= 0.85, "HIGH").when(F.col("score") >= 0.5, "MEDIUM").otherwise("LOW"))
