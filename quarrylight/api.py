"""Questions over a repository's facts, each answered by a lazy DataFrame.

Symbols: (repository_id, commit_sha, moniker, name, qualified, kind, path, start,
end, parent). Relations: (repository_id, commit_sha, source, target, kind, path,
line). Every answer has a total order and a limit where the question states one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import graph, search

MOST, LEAST = 1000, 1


@dataclass
class Facts:
    """The fact tables of a catalogue, optionally narrowed to one commit."""

    symbols: DataFrame
    relations: DataFrame
    repository: str | None = None
    commit: str | None = None

    def _narrow(self, df: DataFrame) -> DataFrame:
        # equality filters on the partition columns prune the scan
        if self.repository is not None:
            df = df.where(F.col("repository_id") == self.repository)
        if self.commit is not None:
            df = df.where(F.col("commit_sha") == self.commit)
        return df

    @property
    def s(self) -> DataFrame:
        return self._narrow(self.symbols)

    @property
    def r(self) -> DataFrame:
        return self._narrow(self.relations)


def _limit(n: int) -> int:
    """Q03: a limit within [1, 1000]."""
    return max(LEAST, min(int(n), MOST))


def _named(c: Column, name: str) -> Column:
    return c == name.strip()


def go_to_definition(f: Facts, name: str, most: int = 100) -> DataFrame:
    """Q01: symbols of a name or moniker."""
    hit = _named(F.col("name"), name) | _named(F.col("moniker"), name) | _named(F.col("qualified"), name)
    return f.s.where(hit).orderBy("path", "start", "moniker").limit(_limit(most))


def _relations(f: Facts, where: Column, most: int) -> DataFrame:
    return f.r.where(where).orderBy("path", "line", "source", "target", "kind").limit(_limit(most))


def find_references(f: Facts, moniker: str, most: int = 100) -> DataFrame:
    """Q01: what a symbol refers to and calls: its outgoing relations."""
    return _relations(f, (F.col("source") == moniker.strip()) & F.col("kind").isin("REFERENCES", "CALLS"), most)


def find_referrers(f: Facts, moniker: str, most: int = 100) -> DataFrame:
    """Q01: who refers to a symbol: its incoming relations."""
    return _relations(f, (F.col("target") == moniker.strip()) & F.col("kind").isin("REFERENCES", "CALLS"), most)


def find_callers(f: Facts, moniker: str, most: int = 100) -> DataFrame:
    """One filtered scan, the target in the filter."""
    return _relations(f, (F.col("target") == moniker.strip()) & (F.col("kind") == "CALLS"), most)


def find_callees(f: Facts, moniker: str, most: int = 100) -> DataFrame:
    """Q01, V32."""
    return _relations(f, (F.col("source") == moniker.strip()) & (F.col("kind") == "CALLS"), most)


def find_imports(f: Facts, path: str, most: int = 100) -> DataFrame:
    """Q01: imports of a file."""
    return _relations(f, (F.col("path") == path.strip()) & (F.col("kind") == "IMPORTS"), most)


def find_exports(f: Facts, path: str, most: int = 100) -> DataFrame:
    """Q01: exports of a file."""
    return _relations(f, (F.col("path") == path.strip()) & (F.col("kind") == "EXPORTS"), most)


def dependency_analysis(f: Facts, path: str, most: int = 100, compat: bool = False) -> DataFrame:
    """Relations of the symbols of a file; with ``compat`` the first relations of the commit, whatever the file."""
    where = F.lit(True) if compat else F.col("path") == path.strip()
    return _relations(f, where, most)


def symbol_search(f: Facts, text: str, most: int = 20) -> DataFrame:
    """Ranked matches."""
    return search.rank_symbols(f.s.select(F.col("moniker").alias("symbol_id"), "name", "qualified", "kind", "path"), text, most)


def module_search(f: Facts, text: str, most: int = 20) -> DataFrame:
    """Q01: files whose path holds the text."""
    return f.s.where(F.lower("path").contains(text.strip().lower())).select("path").distinct().orderBy("path").limit(_limit(most))


def function_search(f: Facts, text: str, most: int = 20) -> DataFrame:
    """Functions and methods by name, qualified name or id."""
    t = text.strip().lower()
    hit = F.lower("name").contains(t) | F.lower("qualified").contains(t) | F.lower("moniker").contains(t)
    return f.s.where(F.col("kind").isin("function", "method") & hit).orderBy("path", "start", "moniker").limit(_limit(most))


def symbol_lookup(f: Facts, dotted: str, context: str | None = None) -> DataFrame:
    """Symbols of a name or ``parent.name``; those of the context path first: equal, ending with it, holding it, others."""
    parent, _, name = dotted.rpartition(".")
    out = f.s.where(F.col("name") == name)
    if parent:
        out = out.where(F.element_at(F.split("parent", r"\."), -1) == parent.rpartition(".")[2])
    c = context or ""
    tier = F.when(F.col("path") == c, 0).when(F.col("path").endswith(c) & F.lit(bool(c)), 1).when(F.col("path").contains(c) & F.lit(bool(c)), 2).otherwise(3)
    return out.withColumn("tier", tier).orderBy("tier", "path", "start", "moniker")


def same_name_symbols(f: Facts, name: str) -> DataFrame:
    """All definitions of a name."""
    return f.s.where(F.col("name") == name).orderBy("path", "start", "moniker")


def cross_references(f: Facts, needle: str) -> DataFrame:
    """Relations of which either end's name holds the text, both ends known."""
    commit = ["repository_id", "commit_sha"]
    n = f.s.select(*commit, "moniker", "name")
    both = f.r.join(n.select(*commit, F.col("moniker").alias("source"), F.col("name").alias("source_name")), [*commit, "source"]).join(n.select(*commit, F.col("moniker").alias("target"), F.col("name").alias("target_name")), [*commit, "target"])
    return both.where(F.col("source_name").contains(needle) | F.col("target_name").contains(needle))


def structural_match(f: Facts, pattern: str, text: str = "") -> DataFrame:
    """P20: class-like or function-like symbols by name, import or inheritance pairs, else any symbol; without case."""
    t = text.lower()
    name = F.lower("name").contains(t)
    if pattern in ("class", "function"):
        kinds = ("class", "interface", "enum") if pattern == "class" else ("function", "method")
        return f.s.where(F.col("kind").isin(*kinds) & name).select("moniker", "name", "path")
    if pattern in ("import", "inheritance"):
        kinds = ("IMPORTS",) if pattern == "import" else ("INHERITS_FROM", "IMPLEMENTS")
        rows = f.r.where(F.col("kind").isin(*kinds))
        if pattern == "import":
            rows = rows.where(F.lower("target").contains(t))
        return rows.select(F.concat_ws(" -> ", "source", "target").alias("moniker"), F.col("kind").alias("name"), "path")
    return f.s.where(name).select("moniker", "name", "path")


def consistency(f: Facts) -> DataFrame:
    """Problems of the tables as rows: unknown ends, spans the wrong way, repeated monikers."""
    known = f.s.select(F.col("moniker").alias("target")).distinct()
    lost = f.r.where("kind not in ('IMPORTS', 'EXPORTS')").join(known, "target", "left_anti").select(F.lit("unknown_target").alias("problem"), F.col("target").alias("subject"))
    wrong = f.s.where(F.col("end") < F.col("start")).select(F.lit("span").alias("problem"), F.col("moniker").alias("subject"))
    twice = f.s.groupBy("repository_id", "commit_sha", "moniker").count().where("count > 1").select(F.lit("repeated").alias("problem"), F.col("moniker").alias("subject"))
    return lost.unionByName(wrong).unionByName(twice).distinct()


#: Q01, Q05: dispatch by the name of a question.
QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "GO_TO_DEFINITION": go_to_definition,
    "FIND_REFERENCES": find_references,
    "FIND_REFERRERS": find_referrers,
    "FIND_CALLERS": find_callers,
    "FIND_CALLEES": find_callees,
    "FIND_IMPORTS": find_imports,
    "FIND_EXPORTS": find_exports,
    "DEPENDENCY_ANALYSIS": dependency_analysis,
    "SYMBOL_SEARCH": symbol_search,
    "MODULE_SEARCH": module_search,
}


@dataclass
class Plan:
    """Q02: a question with its criteria; built without running anything."""

    question: str
    criteria: str
    most: int = 100
    options: dict = field(default_factory=dict)

    def run(self, f: Facts) -> DataFrame:
        """The answer; an unknown question is an error that names the known ones."""
        if self.question not in QUESTIONS:
            raise ValueError(f"{self.question} is none of {sorted(QUESTIONS)}")
        return QUESTIONS[self.question](f, self.criteria, _limit(self.most), **self.options)


def graph_question(kind: str, edges: DataFrame, **given) -> DataFrame:
    """shortest_path, reachability, ancestors, descendants, neighbours, path, entries and cycles over (g, src, dst)."""
    starts = given.get("starts")
    if kind in ("reachability", "descendants"):
        return graph.reach(edges, starts).where("depth > 0")
    if kind in ("ancestors", "impact"):
        return graph.reach(graph.reverse(edges), starts).where("depth > 0")
    if kind in ("shortest_path", "path"):
        targets = given["targets"].select("g", F.col("target").alias("node")).distinct()
        if targets.count() >= starts.count():
            return graph.reach(edges, starts, paths=True).join(targets, ["g", "node"])
        # fewer ends than starts: search from the ends against the edges, listing paths from the start
        found = graph.reach(graph.reverse(edges), targets.withColumnRenamed("node", "start"), paths=True, toward=True)
        found = found.select("g", F.col("node").alias("start"), F.col("start").alias("node"), "depth", "path")
        return found.join(starts.select("g", "start").distinct(), ["g", "start"], "left_semi")
    if kind == "neighbours":
        return graph.neighbours(edges, starts)
    if kind == "entries":
        return graph.nodes(edges).join(edges.select("g", F.col("dst").alias("node")).distinct(), ["g", "node"], "left_anti")
    if kind == "cycles":
        return graph.strong_components(edges)
    raise ValueError(f"{kind} is no graph question")


#: fixed values: intents of questions by words, in the order they are tried
INTENTS = (
    ("impact", "impact|affected|break|blast"),
    ("callers", "who calls|callers? of|called by"),
    ("callees", "what does .* call|callees"),
    ("definition", "where is .* defined|definition of|find definition"),
    ("references", "references? (?:of|to)|usages?"),
    ("dead_code", "dead code|unused|unreachable"),
    ("cycles", "cycles?|circular"),
    ("churn", "churn|hotspots?|often change"),
    ("ownership", "owner|who wrote|bus factor"),
    ("api_surface", "public api|endpoints?|exported"),
    ("architecture", "architecture|layers?|overview|structure"),
    ("dependencies", "depend|imports?"),
    ("tests", "tests?|covered"),
    ("health", "health|quality|score|grade"),
    ("drift", "drift|changed since|difference"),
    ("security", "secret|vulnerab|security"),
    ("documentation", "docs?|documentation|readme"),
    ("performance", "slow|performance|latency"),
    ("search", "find|search|where"),
)


def intent(question: Column) -> Column:
    """Q11, Q12: the first intent whose words stand in a question, else general."""
    q = F.lower(question)
    out = F.when(question.isNull(), F.lit(None))
    for name, words in INTENTS:
        out = out.when(q.rlike(rf"\b(?:{words})"), name)
    return out.otherwise("general")


def entities(question: Column) -> Column:
    """Files, quoted or called symbols and inner-capital identifiers of a question, sorted and different."""
    found = F.concat(
        F.regexp_extract_all(question, F.lit(r"[\w./-]+\.(?:py|js|jsx|ts|tsx|java|go|rs|md|json)\b"), 0),
        F.regexp_extract_all(question, F.lit(r"`([^`]+)`"), 1),
        F.regexp_extract_all(question, F.lit(r"\b([A-Za-z_]\w*)\("), 1),
        F.regexp_extract_all(question, F.lit(r"\b(?:[A-Z][a-z0-9]+){2,}\b|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), 0),
    )
    return F.array_sort(F.array_distinct(found))


def rewritten(question: Column, subject: Column) -> Column:
    """Q13: pronouns of a follow-up question replaced by the subject of the one before, if it names none itself."""
    plain = F.size(entities(question)) == 0
    return F.when(plain & subject.isNotNull(), F.regexp_replace(question, r"(?i)\b(?:it|this|that|they|them)\b", subject)).otherwise(question)
