"""From a question to the passages that answer it, and the texts of reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import api
from quarrylight.functions import paths, text
from quarrylight.operators import search

#: fixed values: paths that retrieval never returns unless they are named
EXCLUDED = r"(?i)(package-lock\.json|pnpm-lock\.yaml|\.lock|\.min\.(js|css)|\.map|\.snap|\.(png|jpe?g|gif|svg|ico|woff2?|ttf|eot|otf|pdf|zip|gz|tar)|\.(pyc|pyo|class|o|a|so|dll|exe|bin))$|(^|/)(node_modules|dist|build|coverage|vendor|\.cache|__pycache__|out|snapshots|\.pytest_cache|\.git|\.venv|\.vscode)/"


def is_excluded(path: Column, named: Column, asks_tests: bool = False) -> Column:
    """Whether retrieval leaves a path out; named paths stay."""
    out = path.rlike(EXCLUDED) | paths.is_generated_path(path)
    if not asks_tests:
        out = out | paths.is_test_path(path)
    return ~named & out


def is_entry_file(path: Column, imports: Column) -> Column:
    """A usual entry name, an app or pages folder, or a framework import at depth two or less."""
    name = F.lower(paths.file_name(path))
    usual = name.isin("main.py", "app.py", "server.py", "index.js", "index.ts", "main.ts", "main.tsx", "manage.py", "wsgi.py", "asgi.py", "cli.py")
    framework = F.arrays_overlap(imports, F.array(*[F.lit(x) for x in ("fastapi", "flask", "django", "express", "next")]))
    return usual | path.startswith("app/") | path.startswith("pages/") | ((F.size(F.split(path, "/")) <= 3) & framework)


def kind_filter(symbols: DataFrame, kinds: list[str] | None = None, visibility: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """A conjunction of filters that Spark pushes to the scan."""
    for column, values in (("kind", kinds), ("visibility", visibility)):
        if values:
            symbols = symbols.where(F.col(column).isin(values))
    return symbols.where(paths.extension(F.col("path")).isin(extensions)) if extensions else symbols


def references_symbol(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(g, path, name) where a file's text holds a symbol's name as a whole word; one token table and an equal join, no pattern for each pair."""
    words = files.select("g", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("name"))
    return words.join(symbols.select("g", "name").distinct(), ["g", "name"], "left_semi").select("g", "path", "name")


def signature(parameters: Column, line: Column) -> dict[str, Column]:
    """Number of parameters without self and cls, and whether the definition is asynchronous."""
    names = F.filter(F.split(F.coalesce(parameters, F.lit("")), ","), lambda p: (p != "") & ~p.isin("self", "cls"))
    return {"param_count": F.size(names), "is_async": F.coalesce(line.rlike(r"\basync\b"), F.lit(False))}


def hashed_vectors(texts: DataFrame, size: int = 64, backend: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(id, embedding) of texts (id, text) by a backend of batches, by default signed feature hashing of words, unit length.

    The backend is made once a worker and gets whole batches, the place for a real model.
    """

    def plain(batch: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(batch), size), np.float32)
        for i, t in enumerate(batch):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    encode = backend or plain

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": list(encode(batch["text"].tolist()))})

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").where("text is not null").mapInPandas(run, f"id {kind}, embedding array<float>")


def gate(question: str, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, tier, confidence): files a question names outright (100 by path, 98 by name, 96 by a symbol); empty where it names none and retrieval has to search."""
    q = F.lit(question.lower())
    by_path = files.where(F.contains(q, F.lower("path"))).select("path", F.lit(1).alias("tier"), F.lit(100).alias("confidence"))
    by_name = files.where((F.length(paths.file_name(F.col("path"))) > 4) & F.contains(q, F.lower(paths.file_name(F.col("path"))))).select("path", F.lit(2).alias("tier"), F.lit(98).alias("confidence"))
    named = symbols.where((F.length("name") > 3) & F.array_contains(api.entities(F.lit(question)), F.col("name"))).select("path", F.lit(3).alias("tier"), F.lit(96).alias("confidence"))
    every = by_path.unionByName(by_name).unionByName(named)
    return every.groupBy("path").agg(F.min("tier").alias("tier"), F.max("confidence").alias("confidence"))


def expand(seeds: DataFrame, facts: api.Facts) -> DataFrame:
    """Context items (id, kind, priority, score) of seed symbols (moniker): definition, callers and callees, references, dependencies; the best of each id."""
    s = seeds.select("moniker").distinct()
    r = facts.r

    def side(kind: str, here: str, there: str, priority: int, score: float) -> DataFrame:
        return r.where(F.col("kind") == kind).join(s.withColumnRenamed("moniker", here), here, "left_semi").select(F.col(there).alias("id"), F.lit(kind.lower()).alias("kind"), F.lit(priority).alias("priority"), F.lit(score).alias("score"))

    parts = [s.select(F.col("moniker").alias("id"), F.lit("definition").alias("kind"), F.lit(1).alias("priority"), F.lit(1.0).alias("score"))]
    parts += [side("REFERENCES", "source", "target", 2, 0.9), side("CALLS", "source", "target", 3, 0.8), side("CALLS", "target", "source", 3, 0.8), side("IMPORTS", "source", "target", 4, 0.7)]
    every = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct("priority", (-F.col("score")).alias("s"), "kind")).alias("b")
    return every.groupBy("id").agg(best).select("id", "b.kind", "b.priority", (-F.col("b.s")).alias("score"))


def context_package(items: DataFrame, contents: DataFrame, budget: int) -> DataFrame:
    """(grp, json) of items (grp, id, priority) with their contents, filled in order to a budget of tokens (a quarter of the characters)."""
    full = items.join(contents.select("id", "content"), "id").withColumn("tokens", F.expr("length(content) div 4"))
    chosen = search.greedy_budget(full.select("grp", "id", "priority", "tokens"), budget)
    rows = full.withColumn("id", F.col("id").cast("string")).join(chosen, ["grp", "id"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("priority", "id", "content")))
    return rows.groupBy("grp").agg(F.to_json(F.struct(ordered.alias("items"))).alias("json"))


#: Executors of retrieval policies; add to them with :func:`register_executor`.
EXECUTORS: dict[str, Callable[..., DataFrame]] = {"expand": expand}
POLICIES: dict[str, list[str]] = {"explain": ["expand"], "impact": ["expand"]}


def last_day(history: DataFrame) -> DataFrame:
    """The rows (conversation, ts, ...) of the last day of each conversation."""
    w = Window.partitionBy("conversation")
    return history.withColumn("_last", F.max("ts").over(w)).where("ts >= _last - interval 1 day").drop("_last")


#: History filters by name.
HISTORY: dict[str, Callable[[DataFrame], DataFrame]] = {"all": lambda history: history, "last_day": last_day}


def register_executor(name: str, executor: Callable[..., DataFrame], policies: tuple[str, ...] = ()) -> None:
    """Add an executor, and to policies."""
    EXECUTORS[name] = executor
    for p in policies:
        POLICIES.setdefault(p, []).append(name)


def retrieve(policy: str, seeds: DataFrame, facts: api.Facts) -> DataFrame:
    """What all executors of a policy return, in one table, up to the assembly of the context."""
    return reduce(DataFrame.unionByName, [EXECUTORS[e](seeds, facts) for e in POLICIES[policy]]).distinct()


def files_for_issue(chunks: DataFrame, query: list[float], k: int = 40) -> DataFrame:
    """Files of the chunks (vec_id, path, embedding) nearest to an issue's vector, best chunk first. A top-k report."""
    near = search.nearest_to(chunks, query, k)
    return search.best_chunk(chunks.select("vec_id", "path").join(near, "vec_id").select("path", "distance"))


def same_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, path) that only one of two retrievals returned."""
    only = lambda x, y, n: x.select("path").distinct().join(y.select("path").distinct(), "path", "left_anti").select(F.lit(n).alias("side"), "path")
    return only(a, b, "first").unionByName(only(b, a, "second"))


def bracket_citations(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(answer_id, ref_id, known) of ``[id]`` marks in answers."""
    found = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([\w.-]+)\]"), 1))).alias("ref_id"))
    known = references.select("answer_id", F.col("ref_id"), F.lit(True).alias("known")).distinct()
    return found.join(known, ["answer_id", "ref_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def api_search(surface: DataFrame, text_: str, most: int = 50, **equal: str) -> DataFrame:
    """Public symbols by a part of their name and equal fields. A top-k report."""
    out = surface.where(F.lower("name").contains(text_.lower()))
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out.orderBy("path", "name").limit(max(1, min(most, 50)))


def merged_references(references: DataFrame) -> DataFrame:
    """(id, score): references merged by id, the weight of their type, 3 for a hotspot and 5 for a named entity."""
    weight = F.when(F.col("type") == "file", 10).when(F.col("type") == "symbol", 8).when(F.col("type") == "commit", 5).otherwise(2)
    return references.groupBy("id").agg((F.max(weight) + 3 * F.max(F.col("hotspot").cast("int")) + 5 * F.max(F.col("named").cast("int"))).alias("score"))


def seed_tokens(question: Column, most: int = 20) -> Column:
    """Different words of a question of four letters or more, longest first, at most twenty: the feature itself."""
    words = F.filter(text.token_set(question), lambda w: F.length(w) >= 4)
    order = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(order, lambda s: s["w"]), 1, most)


def seed_files(questions: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """(id, path, score): files whose path holds a question's words, by the letters they match, ten a question. A top-k report.

    Words and path parts meet in one equal join, so no question is compared with every file.
    """
    q = questions.select("id", F.explode(seed_tokens(F.col("text"))).alias("w"))
    parts = files.select("path").distinct().select("path", F.explode(F.array_distinct(F.split(F.lower("path"), r"[^a-z0-9]+"))).alias("w")).where("length(w) >= 4")
    hit = q.join(parts, "w").groupBy("id", "path").agg(F.sum(F.length("w")).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "path")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def plan_steps(impact: DataFrame) -> DataFrame:
    """(id, steps) of up to five numbered steps for changes (id, seeds, direct, callers, routes, tests); three standard ones when nothing is known."""

    def named(title: str, column: str, most: int) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(F.array_sort(column), 1, most), ", ")))

    steps = F.array_compact(F.array(named("Change", "seeds", 2), named("Update direct users", "direct", 3), named("Check callers", "callers", 3), named("Review routes", "routes", 3), named("Run tests", "tests", 3)))
    usual = F.array(F.lit("Find the affected files"), F.lit("Change them"), F.lit("Run the tests"))
    chosen = F.when(F.size(steps) > 0, steps).otherwise(usual)
    return impact.select("id", F.transform(chosen, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)).alias("steps"))


def repository_summary(files: DataFrame, statistics: DataFrame) -> DataFrame:
    """(g, summary): one struct of counts, languages and graph figures for each repository."""
    main = files.groupBy("g", paths.language(F.col("path")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    by = main.groupBy("g").agg(F.sum("n").alias("files"), F.max_by("l", F.struct("n", "l")).alias("language"))
    return by.join(statistics, "g", "left").select("g", F.struct("files", "language", "nodes", "edges", "density").alias("summary"))


def dependency_story(edges: DataFrame) -> DataFrame:
    """(g, node, text) of each node's direct neighbours as a sentence, names sorted."""
    out = edges.groupBy("g", F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("uses"))
    into = edges.groupBy("g", F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("src")), ", ").alias("used"))
    both = out.join(into, ["g", "node"], "full")
    return both.select("g", "node", F.concat_ws("; ", F.when(F.col("uses").isNotNull(), F.concat(F.lit("uses "), "uses")), F.when(F.col("used").isNotNull(), F.concat(F.lit("is used by "), "used"))).alias("text"))
