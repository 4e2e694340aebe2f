"""Knowledge graphs out of facts, their views, and findings about a code base."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import paths
from quarrylight.operators import scoring

#: Providers (nodes, edges) of a knowledge graph; add to it with :func:`register_provider`.
PROVIDERS: dict[str, Callable[[dict[str, DataFrame]], tuple[DataFrame, DataFrame]]] = {}


def register_provider(name: str, provider: Callable[[dict[str, DataFrame]], tuple[DataFrame, DataFrame]]) -> None:
    PROVIDERS[name] = provider


def _node(df: DataFrame, kind: str, key: Column, name: Column) -> DataFrame:
    return df.select("g", F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"))


def directories(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Repository, directory and file nodes with CONTAINS edges down the folder chain."""
    f = tables["files"].select("g", "path").where("path is not null").distinct()
    part = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(part) - 1), lambda i: F.array_join(F.slice(part, 1, i), "/"))
    folders = f.select("g", F.explode(chain).alias("dir")).where("dir <> ''").distinct()
    repo = F.concat(F.lit("repository:"), F.col("g"))
    nodes = f.select("g").distinct().select("g", repo.alias("id"), F.lit("repository").alias("kind"), F.col("g").alias("name"))
    nodes = nodes.unionByName(_node(folders, "directory", F.col("dir"), paths.file_name(F.col("dir")))).unionByName(_node(f, "file", F.col("path"), paths.file_name(F.col("path"))))

    def parent(path: Column) -> Column:
        d = paths.directory(path)
        return F.when(d == "", repo).otherwise(F.concat(F.lit("directory:"), d))

    edges = folders.select("g", parent(F.col("dir")).alias("src"), F.concat(F.lit("directory:"), "dir").alias("dst")).unionByName(f.select("g", parent(F.col("path")).alias("src"), F.concat(F.lit("file:"), "path").alias("dst")))
    return nodes, edges.withColumn("kind", F.lit("CONTAINS"))


def declarations(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Symbol nodes with DECLARES edges from their file, or from their class for methods."""
    s = tables["facts"].where("fact = 'symbol'").select("g", "path", "parent", "name").distinct()
    dotted = F.concat_ws(".", "parent", "name")
    nodes = _node(s, "symbol", F.concat_ws("#", "path", dotted), F.col("name")).distinct()
    src = F.when(F.col("parent").isNull(), F.concat(F.lit("file:"), "path")).otherwise(F.concat(F.lit("symbol:"), F.concat_ws("#", "path", "parent")))
    edges = s.select("g", src.alias("src"), F.concat(F.lit("symbol:"), F.concat_ws("#", "path", dotted)).alias("dst"), F.lit("DECLARES").alias("kind"))
    return nodes, edges.distinct()


def file_imports(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """IMPORTS edges between files."""
    e = tables["file_edges"]
    nodes = tables["files"].where("false").select("g", F.lit("").alias("id"), F.lit("").alias("kind"), F.lit("").alias("name"))
    return nodes, e.select("g", F.concat(F.lit("file:"), "src").alias("src"), F.concat(F.lit("file:"), "dst").alias("dst"), F.lit("IMPORTS").alias("kind"))


for _name, _provider in (("directories", directories), ("declarations", declarations), ("imports", file_imports)):
    register_provider(_name, _provider)


def knowledge_graph(tables: dict[str, DataFrame], providers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, id, kind, name) and edges (g, src, dst, kind) of all providers, each once, both ends known."""
    made = [PROVIDERS[p](tables) for p in (providers or list(PROVIDERS))]
    nodes = reduce(DataFrame.unionByName, [n for n, _ in made])
    nodes = nodes.groupBy("g", "id").agg(F.min("kind").alias("kind"), F.min("name").alias("name"))
    edges = reduce(DataFrame.unionByName, [e for _, e in made]).distinct()
    ends = nodes.select("g", "id")
    edges = edges.join(ends.withColumnRenamed("id", "src"), ["g", "src"], "left_semi").join(ends.withColumnRenamed("id", "dst"), ["g", "dst"], "left_semi")
    return nodes, edges.select("g", "src", "dst", "kind")


def breakdown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, what, kind, n) of nodes and edges."""
    n = nodes.groupBy("g", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("node"))
    return n.unionByName(edges.groupBy("g", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edge"))).select("g", "what", "kind", "n")


def ripple(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Per graph the edges that touch changed nodes (g, id) by kind, and how many nodes lie at their other end."""
    out = edges.join(changed.select("g", F.col("id").alias("src")), ["g", "src"]).select("g", "kind", F.col("dst").alias("other"))
    into = edges.join(changed.select("g", F.col("id").alias("dst")), ["g", "dst"]).select("g", "kind", F.col("src").alias("other"))
    return out.unionByName(into).groupBy("g", "kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("other").alias("nodes"))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, source, kind, target) by names."""
    a = nodes.select("g", F.col("id").alias("src"), F.col("name").alias("source"))
    b = nodes.select("g", F.col("id").alias("dst"), F.col("name").alias("target"))
    return edges.join(a, ["g", "src"]).join(b, ["g", "dst"]).select("g", "source", "kind", "target")


def graph_sample(edges: DataFrame, central: DataFrame, most: int = 500) -> DataFrame:
    """Of each graph the ``most`` nodes by centrality and degree, tests, docs and examples folded into one node each. A sampling operator."""
    group = F.when(F.col("node").rlike(r"(^|[/:])tests?/"), "tests/").when(F.col("node").rlike(r"(^|[/:])docs?/"), "docs/").when(F.col("node").rlike(r"(^|[/:])examples?/"), "examples/").otherwise(F.col("node"))
    folded = central.select("g", group.alias("node"), "centrality", (F.col("fan_in") + F.col("fan_out")).alias("degree")).groupBy("g", "node").agg(F.max("centrality").alias("centrality"), F.sum("degree").alias("degree"))
    w = Window.partitionBy("g").orderBy(F.desc("centrality"), F.desc("degree"), "node")
    return folded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rank_and_tier(scored: DataFrame, entries: DataFrame) -> DataFrame:
    """Dense 1-based rank of (g, node, score) and its tier: entry, core above 20, service, utility or other."""
    w = Window.partitionBy("g").orderBy(F.desc("score"), "node")
    e = entries.select("g", "node").distinct().withColumn("entry", F.lit(True))
    n = F.lower("node")
    tier = F.when(F.col("entry"), "entry").when(F.col("score") > 20, "core").when(n.contains("service"), "service").when(n.contains("util") | n.contains("helper"), "utility").otherwise("other")
    return scored.join(e, ["g", "node"], "left").select("g", "node", "score", F.row_number().over(w).alias("rank"), tier.alias("tier"))


# ---------------------------------------------------------------- findings

FINDING = ["g", "category", "severity", "subject", "confidence"]


def _found(df: DataFrame, category: str, severity: str | Column, subject: Column, confidence: float = 0.9) -> DataFrame:
    s = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("g", F.lit(category).alias("category"), s.alias("severity"), subject.alias("subject"), F.lit(confidence).alias("confidence"))


def complexity_findings(metrics: DataFrame) -> DataFrame:
    """Bodies (g, path, complexity) above 15, high above 50."""
    return _found(metrics.where("complexity > 15"), "complexity", F.when(F.col("complexity") > 50, "high").otherwise("medium"), F.col("path"))


def large_file_findings(files: DataFrame) -> DataFrame:
    """Files over 100,000 bytes."""
    return _found(files.where("size_bytes > 100000"), "performance", "low", F.col("path"))


def documentation_findings(files: DataFrame) -> DataFrame:
    """Repositories without a readme."""
    n = files.groupBy("g").agg(F.count_if(F.lower(paths.file_name(F.col("path"))).startswith("readme")).alias("n")).where("n = 0")
    return _found(n, "documentation", "medium", F.lit("README"))


def testing_findings(files: DataFrame) -> DataFrame:
    """Repositories without tests (high) or with fewer than three test files (medium)."""
    n = files.select("g", "path").distinct().groupBy("g").agg(F.count_if(paths.is_test_path(F.col("path"))).alias("n")).where("n < 3")
    return _found(n, "testing", F.when(F.col("n") == 0, "high").otherwise("medium"), F.concat(F.col("n"), F.lit(" test files")))


def security_findings(bodies: DataFrame) -> DataFrame:
    """Bodies (g, path, content) that hold a secret by form."""
    from quarrylight.functions.text import SECRETS

    return _found(bodies.where(F.col("content").rlike(SECRETS)), "security", "critical", F.col("path"), 0.8)


def coupling_findings(mutual: DataFrame) -> DataFrame:
    """Nodes that depend on each other."""
    return _found(mutual, "dependency", "high", F.concat_ws(" <-> ", "a", "b"))


def cyclic_pair_findings(edges: DataFrame, most: int = 30) -> DataFrame:
    """Nodes that depend on each other, from either end, and graphs of more than ``most`` dependencies."""
    e = edges.select("g", "src", "dst").where("src <> dst").distinct()
    both = e.join(e.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")), ["g", "src", "dst"], "left_semi")
    many = edges.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return _found(both, "dependency", "high", F.concat_ws(" -> ", "src", "dst")).unionByName(_found(many, "dependency", "medium", F.concat("n", F.lit(" dependencies"))))


def dead_code_findings(dead: DataFrame) -> DataFrame:
    """Nodes no entry reaches."""
    return _found(dead, "dead_code", "low", F.col("node"))


def inspection(parts: list[DataFrame]) -> DataFrame:
    """All findings in one table, each subject of a category once with its greatest severity."""
    order = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")])
    every = reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
    best = F.min(F.struct(F.array_position(order, F.col("severity")).alias("r"), F.col("severity").alias("s")))
    return every.groupBy("g", "category", "subject").agg(best["s"].alias("severity"), F.max("confidence").alias("confidence"))


def recommendations(findings: DataFrame) -> DataFrame:
    """Per graph and category priority, label, hours, phase and batch order of the work."""
    base = scoring.by_value(F.col("severity"), {"critical": 60.0, "high": 40.0, "medium": 20.0, "low": 10.0}, 5.0)
    per = findings.groupBy("g", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("entities"), F.max(base).alias("base"), F.max("confidence").alias("confidence"))
    score, label = scoring.priority(F.col("base"), scoring.by_value(F.col("category"), {"security": 20.0, "dependency": 15.0, "complexity": 10.0}, 5.0), F.col("n"), F.col("entities"), F.col("confidence"))
    hours = F.round(scoring.by_value(F.col("category"), {"security": 4.0, "dependency": 6.0, "complexity": 8.0, "testing": 6.0}, 2.0) * (1 + 0.1 * F.least("entities", F.lit(20))), 2)
    phase = F.when(label == "critical", 1).otherwise(scoring.by_value(F.col("category"), {"security": 1, "dependency": 2, "complexity": 3, "testing": 3}, 4)).cast("int")
    out = per.select("g", "category", "n", score.alias("score"), label.alias("label"), hours.alias("hours"), phase.alias("phase"))
    return out.withColumn("step", F.row_number().over(Window.partitionBy("g").orderBy("phase", F.desc("score"), "category")))


def reasoning(evidence: DataFrame) -> DataFrame:
    """(claim, confidence): mean weight of the evidence kinds in per cent, less 25 for each contradiction, at least 0."""
    weight = scoring.by_value(F.col("kind"), scoring.EVIDENCE, 0.25)
    out = evidence.groupBy("claim").agg(F.avg(weight).alias("w"), F.count_if(F.col("contradicts")).alias("c"))
    return out.select("claim", F.greatest(F.lit(0.0), F.round(100 * F.col("w") - 25 * F.col("c"), 2)).alias("confidence"))


#: Concepts of a course, at most.
MOST_CONCEPTS = 1_000


def learning_gaps(steps: DataFrame, wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """(learner, concept, reason): concepts without a completed step, or with a score under 60."""
    concepts = [r["concept"] for r in wanted.select("concept").distinct().orderBy("concept").limit(MOST_CONCEPTS + 1).collect()]
    if len(concepts) > MOST_CONCEPTS:
        raise ValueError(f"more than {MOST_CONCEPTS} concepts")
    every = F.array(*[F.lit(c) for c in concepts]).cast("array<string>")
    done = steps.select("learner", F.explode(F.filter(every, lambda c: F.contains(F.lower("title"), F.lower(c)))).alias("concept")).distinct()
    need = steps.select("learner").distinct().select("learner", F.explode(every).alias("concept"))
    missing = need.join(done, ["learner", "concept"], "left_anti").withColumn("reason", F.lit("missing"))
    weak = scores.where("score < 60").select("learner", "concept", F.lit("weak").alias("reason"))
    return missing.unionByName(weak).distinct()


def impact_tiers(evidence: DataFrame) -> DataFrame:
    """(g, file, tier, score) of affected files by their best evidence (g, file, kind)."""
    weight = scoring.by_value(F.col("kind"), scoring.EVIDENCE, 0.25)
    out = evidence.groupBy("g", "file").agg(F.max(weight).alias("score"))
    return out.withColumn("tier", scoring.ladder(F.col("score"), [(0.85, "HIGH"), (0.5, "MEDIUM")], "LOW"))


def operating_points(tiers: DataFrame) -> DataFrame:
    """(g, mode, files): SAFE lists HIGH, BALANCED MEDIUM as well, EXPLORATORY all."""
    modes = F.when(F.col("tier") == "HIGH", F.array(F.lit("SAFE"), F.lit("BALANCED"), F.lit("EXPLORATORY"))).when(F.col("tier") == "MEDIUM", F.array(F.lit("BALANCED"), F.lit("EXPLORATORY"))).otherwise(F.array(F.lit("EXPLORATORY")))
    return tiers.select("g", F.explode(modes).alias("mode")).groupBy("g", "mode").agg(F.count(F.lit(1)).alias("files"))


def boundary_crossings(edges: DataFrame) -> DataFrame:
    """(g, src_component, dst_component, edges) between different first components of two nodes."""
    a, b = F.try_element_at(paths.components(F.col("src")), F.lit(1)), F.try_element_at(paths.components(F.col("dst")), F.lit(1))
    out = edges.select("g", a.alias("src_component"), b.alias("dst_component")).where("src_component <> dst_component")
    return out.groupBy("g", "src_component", "dst_component").agg(F.count(F.lit(1)).alias("edges"))


def topic_switches(turns: DataFrame) -> DataFrame:
    """(conversation, turn, kind, confidence) where a turn's entity or file differs from the one before."""
    w = Window.partitionBy("conversation").orderBy("turn")
    out = turns.select("conversation", "turn", "entity", "file", F.lag("entity").over(w).alias("e0"), F.lag("file").over(w).alias("f0"))
    kind = F.when(F.col("e0").isNotNull() & ~F.col("entity").eqNullSafe(F.col("e0")), F.struct(F.lit("EXPLICIT_ENTITY").alias("kind"), F.lit(0.99).alias("confidence"))).when(F.col("f0").isNotNull() & ~F.col("file").eqNullSafe(F.col("f0")), F.struct(F.lit("FILE").alias("kind"), F.lit(0.95).alias("confidence")))
    return out.withColumn("k", kind).where("k is not null").select("conversation", "turn", "k.kind", "k.confidence")
