"""Call graphs, ordered traversals and views of module graphs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import paths
from quarrylight.operators import graph

#: Nodes of a graph that an ordered traversal takes into one task, at most.
MOST_NODES = 200_000


def call_graph(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of resolved calls (g, caller, callee, line, confidence).

    edges: (g, src, dst, line, confidence) once for each pair, with its first line.
    nodes: (g, node, fan_in, fan_out, is_entry, is_recursive).
    """
    known = calls.dropna(subset=["g", "caller", "callee"])
    edges = known.groupBy("g", F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.min("line").alias("line"), F.min_by("confidence", "line").alias("confidence"))
    loops = edges.where("src = dst").select("g", F.col("src").alias("node"), F.lit(True).alias("is_recursive"))
    nodes = graph.degrees(edges).join(loops, ["g", "node"], "left")
    return edges, nodes.select("g", "node", "fan_in", "fan_out", (F.col("fan_in") == 0).alias("is_entry"), F.coalesce("is_recursive", F.lit(False)).alias("is_recursive"))


def partial_call_graph(old: DataFrame, calls: DataFrame, changed: DataFrame, renamed: DataFrame) -> DataFrame:
    """Call edges after an update: those of changed files (g, path) anew, and those of other files whose callee name changed (g, name) as well, so that a partial build equals a full one.

    old and calls: (g, path, caller, callee, name, line).
    """
    stale = old.join(changed.select("g", "path"), ["g", "path"], "left_anti").join(renamed.select("g", "name"), ["g", "name"], "left_anti")
    hit = calls.join(changed.select("g", "path"), ["g", "path"], "left_semi").unionByName(calls.join(renamed.select("g", "name"), ["g", "name"], "left_semi"))
    return stale.unionByName(hit).distinct().select(old.columns)


def update_index(postings: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """An inverted index (term, path) after files changed or left: their postings go, new ones come."""
    return postings.join(changed.select("path").distinct(), "path", "left_anti").select("term", "path").unionByName(new.select("term", "path")).distinct()


def caller_closure(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(g, start, node, depth, path, tier) of callers with the smallest shortest path; HIGH at depth 1, MEDIUM beyond."""
    out = graph.reach(graph.reverse(edges), starts, depth, paths=True).where("depth > 0")
    return out.withColumn("tier", F.when(F.col("depth") == 1, "HIGH").otherwise("MEDIUM"))


def layer_transitions(paths_found: DataFrame) -> DataFrame:
    """Paths with the number of consecutive nodes of different layers; distance -1 where there is no path."""
    layers = F.transform("path", paths.layer)
    steps = F.zip_with(layers, F.slice(layers, 2, F.greatest(F.size(layers), F.lit(1))), lambda a, b: F.when(b.isNotNull() & (a != b), 1).otherwise(0))
    return paths_found.withColumn("transitions", F.when(F.col("path").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda s, v: s + v))).withColumn("distance", F.when(F.col("path").isNull(), F.lit(-1)).otherwise(F.size("path") - 1))


def module_dependencies(edges: DataFrame) -> DataFrame:
    """(g, module, depends_on) of dependencies (g, src, dst) folded to modules, targets sorted."""
    module = lambda c: F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"/[^/]*$", "")
    m = edges.select("g", module(F.col("src")).alias("module"), module(F.col("dst")).alias("other")).where("module <> other").distinct()
    return m.groupBy("g", "module").agg(F.array_sort(F.collect_set("other")).alias("depends_on"))


def architecture_findings(edges: DataFrame) -> DataFrame:
    """(g, finding, subject): an infrastructure node that uses an application one, a callable nobody uses, a node of degree over ten."""
    a, b = paths.layer(F.col("src")), paths.layer(F.col("dst"))
    bad = edges.where((a == "Infrastructure") & (b == "Application")).select("g", F.lit("violation").alias("finding"), F.concat_ws(" -> ", "src", "dst").alias("subject"))
    d = graph.degrees(edges)
    orphan = d.where("fan_in = 0").select("g", F.lit("orphan").alias("finding"), F.col("node").alias("subject"))
    hot = d.where("fan_in + fan_out > 10").select("g", F.lit("hotspot").alias("finding"), F.col("node").alias("subject"))
    return bad.unionByName(orphan).unionByName(hot)


def sample_paths(edges: DataFrame, starts: DataFrame, depth: int = 4, each: int = 5) -> DataFrame:
    """Up to ``each`` shortest dependency paths for each start, shortest first. A sampling operator."""
    w = Window.partitionBy("g", "start").orderBy("depth", "path")
    found = graph.reach(edges, starts, depth, paths=True).where("depth > 0")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= each).drop("n")


def _ordered(edges: DataFrame, extra: DataFrame, run, schema: str) -> DataFrame:
    """A traversal whose order matters, one task for each graph of bounded size; a larger one is an error."""

    def bounded(key, e, x):
        if len(e) > MOST_NODES:
            raise ValueError(f"{len(e)} edges in one graph are too many for an ordered traversal")
        return run(key, e, x)

    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides may stem from one table
    return fresh(edges.select("g", "src", "dst")).groupBy("g").cogroup(fresh(extra).groupBy("g")).applyInPandas(lambda key, e, x: bounded(key, e, x), schema)


def depth_first(edges: DataFrame, starts: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """(g, start, node, depth, ord) in preorder, successors in order of name, each node once for each start."""

    def run(key, e, s):
        nexts: dict = {}
        for a, b in sorted(set(zip(e["src"], e["dst"], strict=True))):
            nexts.setdefault(a, []).append(b)
        rows = []
        for start in sorted(set(s["start"])):
            seen, stack, n = set(), [(start, 0)], 0
            while stack:
                node, d = stack.pop()
                if node in seen:
                    continue
                seen.add(node)
                rows.append((key[0], start, node, d, n))
                n += 1
                if d < max_depth:
                    stack += [(b, d + 1) for b in reversed(nexts.get(node, []))]
        return pd.DataFrame(rows, columns=["g", "start", "node", "depth", "ord"])

    return _ordered(edges, starts, run, "g string, start string, node string, depth int, ord int")


def best_first(edges: DataFrame, scored: DataFrame, most: int = 50) -> DataFrame:
    """(g, node, ord): from entries and nodes without predecessors the highest score first, ties by name; what is left follows by score. ``most`` nodes of each graph, the feature itself.

    scored: (g, node, score, entry).
    """

    def run(key, e, s):
        nexts: dict = {}
        for a, b in zip(e["src"], e["dst"], strict=True):
            nexts.setdefault(a, set()).add(b)
        score = dict(zip(s["node"], s["score"], strict=True))
        targets = set(e["dst"])
        heads = {n for n, entry in zip(s["node"], s["entry"], strict=True) if entry or n not in targets}
        heap = [(-score[n], n) for n in heads]
        heapq.heapify(heap)
        order: list = []
        seen = set(heads)
        while heap and len(order) < most:
            _, n = heapq.heappop(heap)
            order.append(n)
            for b in nexts.get(n, ()):
                if b in score and b not in seen:
                    seen.add(b)
                    heapq.heappush(heap, (-score[b], b))
        rest = sorted((n for n in score if n not in seen), key=lambda n: (-score[n], n))
        order = (order + rest)[:most]
        return pd.DataFrame({"g": key[0], "node": order, "ord": range(len(order))})

    return _ordered(edges, scored, run, "g string, node string, ord int")


def visibility_counts(symbols: DataFrame) -> DataFrame:
    """(g, public, internal, private, routes, entries, orphans, languages) of classified symbols."""
    return symbols.groupBy("g").agg(
        *[F.count_if(F.col("visibility") == v.upper()).alias(v) for v in ("public", "internal", "private")],
        F.count_if(F.coalesce("route", F.lit(False))).alias("routes"),
        F.count_if(F.coalesce("is_orphan", F.lit(False))).alias("orphans"),
        F.countDistinct(paths.language(F.col("path"))).alias("languages"),
    )


def throughput(runs: DataFrame) -> DataFrame:
    """(stage, files, seconds, files_per_second), 0 where no time passed."""
    out = runs.groupBy("stage").agg(F.sum("files").alias("files"), F.sum("seconds").alias("seconds"))
    return out.withColumn("files_per_second", F.when(F.col("seconds") > 0, F.col("files") / F.col("seconds")).otherwise(F.lit(0.0)))
