"""Search over symbols, ranking, budgets and retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import paths, text

#: fixed values: score of each kind of match
MATCH = {"EXACT": 1.0, "QUALIFIED_NAME": 0.9, "PREFIX": 0.8, "CAMEL_CASE": 0.7, "SUBSTRING": 0.6, "FUZZY": 0.5, "FILE_PATH": 0.4}


def match_kind(name: Column, qualified: Column, path: Column, query: str) -> Column:
    """The kind of the best match of a symbol with a query, null for none."""
    q, n = query.lower(), F.lower(name)
    letters = paths.any_of([F.lit(False)]) if not q else None
    fuzzy = letters if letters is not None else ~paths.any_of([~n.contains(c) for c in dict.fromkeys(q)])
    return (
        F.when(n == q, "EXACT")
        .when(F.lower(qualified) == q, "QUALIFIED_NAME")
        .when(n.startswith(q), "PREFIX")
        .when(text.camel_match(name, F.lit(query)), "CAMEL_CASE")
        .when(n.contains(q), "SUBSTRING")
        .when(fuzzy, "FUZZY")
        .when(F.lower(path).contains(q), "FILE_PATH")
    )


def rank_symbols(symbols: DataFrame, query: str, most: int = 20) -> DataFrame:
    """(symbol_id, name, kind, score): the best matches, ties to the least id. A top-k report."""
    query = query.strip()
    most = max(1, min(most, 500))
    kind = match_kind(F.col("name"), F.col("qualified"), F.col("path"), query)
    score = F.create_map(*[F.lit(x) for kv in MATCH.items() for x in kv])
    out = symbols.withColumn("kind", kind).where("kind is not null")
    return out.select("symbol_id", "name", "kind", score[F.col("kind")].alias("score")).orderBy(F.desc("score"), "symbol_id").limit(most)


def autocomplete(symbols: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """(name, score) of distinct names: 0.9 for a prefix, 0.6 for a part. A top-k report."""
    p, n = prefix.lower(), F.lower("name")
    score = F.when(n.startswith(p), 0.9).when(n.contains(p), 0.6)
    return symbols.select("name").distinct().withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "name").limit(most)


def highlighted(c: Column, query: str) -> Column:
    """Every match of the literal query, without case, in square brackets."""
    if not query:
        return c
    literal = "".join("\\" + x if not x.isalnum() else x for x in query)
    return F.regexp_replace(c, f"(?i)({literal})", "[$1]")


def pick_by_priority(symbols: DataFrame) -> DataFrame:
    """Of the symbols of one lower-case name the first by kind, then id."""
    order = F.array_position(F.array(*[F.lit(k) for k in ("class", "function", "method", "interface", "enum", "variable")]), F.lower("kind"))
    w = Window.partitionBy(F.lower("name")).orderBy(F.when(order == 0, 99).otherwise(order), "symbol_id")
    return symbols.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def context_rank(items: DataFrame, symbols: list[str], files: list[str]) -> DataFrame:
    """(id, score): 0.2 for each target symbol in the content, 0.15 for each target file in the path, within [0, 1]."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    for s in symbols:
        score = score + F.when(F.col("content").contains(s), 0.2).otherwise(0.0)
    for f in files:
        score = score + F.when(F.col("path").contains(f), 0.15).otherwise(0.0)
    return items.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, null for a null, empty, zero or wrongly sized one."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest_to(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(vec_id, distance) of the k vectors nearest to one query by cosine: max(0, 1 - cos), four digits. A top-k report."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.withColumn("c", cosine(F.col("embedding"), q)).where("c is not null")
    return out.select("vec_id", F.greatest(F.lit(0.0), F.round(1 - F.col("c"), 4)).alias("distance")).orderBy("distance", "vec_id").limit(k)


def nearest_l2(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The same by squared Euclidean distance."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.aggregate(F.zip_with("embedding", q, lambda p, r: (p.cast("double") - r) * (p.cast("double") - r)), F.lit(0.0), lambda s, v: s + v)
    return vectors.where(f"size(embedding) = {len(query)}").select("vec_id", F.round(d, 6).alias("distance")).orderBy("distance", "vec_id").limit(k)


#: Vectors and queries that are compared in one task at a time.
POINT_BLOCK, QUERY_BLOCK = 8_192, 4_096


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 10, squared: bool = False) -> DataFrame:
    """(query_id, vec_id, distance) of the k vectors nearest to each query vector, exactly.

    vectors, queries: (vec_id, embedding). The distance is that of :func:`nearest_to`, or
    with ``squared`` that of :func:`nearest_l2`; ties go to the smaller id. Blocks of queries
    meet blocks of vectors of the same size in one task each, which keeps k of a query.
    Nulls, vectors that hold NaN and, for the cosine, zero vectors are left out.
    """
    spread = lambda df, rows, name: df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("n"), F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-df.count() // rows)))).alias(name))
    points, asked = spread(vectors, POINT_BLOCK, "p"), spread(queries, QUERY_BLOCK, "q")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("n", "q", "p", "vec_id", "embedding")])  # noqa: E731  both sides stem from one table
    ask = fresh(asked.join(F.broadcast(points.select(F.col("n").alias("n"), F.col("p").alias("p")).distinct()), "n"))
    offer = fresh(points.join(F.broadcast(asked.select(F.col("n").alias("n"), F.col("q").alias("q")).distinct()), "n"))

    def unpack(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if not len(part):
            return np.zeros(0, np.int64), np.zeros((0, 0))
        x = np.stack([np.asarray(v, np.float64) for v in part["embedding"]])
        norm = np.sqrt((x * x).sum(1))
        keep = np.isfinite(norm) & (squared | (norm > 0))
        return part["vec_id"].values[keep], x[keep] if squared else x[keep] / norm[keep, None]

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        (qid, qx), (pid, px) = unpack(q), unpack(p)
        out = []
        for i, v in zip(qid, qx, strict=True) if len(pid) else ():
            d = np.floor(((px - v) ** 2).sum(1) * 1e6 + 0.5) / 1e6 if squared else np.maximum(0.0, np.floor((1 - px @ v) * 1e4 + 0.5) / 1e4)
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            near = near[np.lexsort((pid[near], d[near]))][:k]
            out.append(pd.DataFrame({"query_id": i, "vec_id": pid[near], "distance": d[near]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["query_id", "vec_id", "distance"])

    found = ask.groupBy("n", "q", "p").cogroup(offer.groupBy("n", "q", "p")).applyInPandas(best, "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where(f"r <= {k}").drop("r")


#: fixed values: rank classes of a path in retrieval (label, score)
CLASSES = (("generated", 1e3), ("test", 1e4), ("config", 4e5), ("docs", 2.5e5), ("example", 2e5), ("production", 7e5))


def rank_class(path: Column, question: str, asks_tests: bool = False) -> Column:
    """The class score of a path for a question: named path, named file, then by category."""
    q = question.lower()
    name = paths.file_name(F.lower(path))
    label = paths.category(path)
    out = F.when(F.contains(F.lit(q), F.lower(path)), 1e6).when(F.contains(F.lit(q), name), 9e5)
    for kind, score in CLASSES:
        out = out.when(label == kind, 3e5 if kind == "test" and asks_tests else score)
    return out.otherwise(2e5)


def hybrid_rank(chunks: DataFrame, question: str, k: int = 5) -> DataFrame:
    """(chunk_id, path, total) of the best chunks (chunk_id, path, content, distance).

    total = class + 1e4 / (1 + distance) + 5e3 * overlap + 1e3 / (length of path + 1);
    a file's third and further chunk counts max(0.3, 1 - 0.3 (n - 1)) of it; equal
    contents appear once, the best one. A top-k report.
    """
    total = rank_class(F.col("path"), question) + 1e4 / (1 + F.col("distance")) + 5e3 * text.overlap(F.lit(question), F.col("content")) + 1e3 / (F.length("path") + 1)
    w = Window.partitionBy("path").orderBy("distance", "chunk_id")
    out = chunks.withColumn("n", F.row_number().over(w)).withColumn("total", total * F.when(F.col("n") > 2, F.greatest(F.lit(0.3), 1 - 0.3 * (F.col("n") - 1))).otherwise(1.0))
    best = Window.partitionBy(F.md5(F.trim("content"))).orderBy(F.desc("total"), "chunk_id")
    out = out.withColumn("m", F.row_number().over(best)).where("m = 1")
    return out.select("chunk_id", "path", F.round("total", 4).alias("total")).orderBy(F.desc("total"), "chunk_id").limit(k)


def prefix_budget(items: DataFrame, budget: int) -> DataFrame:
    """The items (grp, id, weight, tokens) by falling weight until the first that would exceed the budget of its group."""
    w = Window.partitionBy("grp").orderBy(F.desc("weight"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def greedy_budget(items: DataFrame, budget: int) -> DataFrame:
    """(grp, id) filled in order of (priority, id), passing over what does not fit; a first item too big stays alone.

    A fold over the group's sorted array in the JVM; a group is the context of one question.
    """
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    item = F.struct("priority", F.col("id").cast("string").alias("id"), F.col("tokens").cast("long").alias("tokens"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x["tokens"] <= budget) | ((s["used"] == 0) & (x["priority"] == 1) & (F.size(s["ids"]) == 0))
        return F.when(fits, F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s)

    out = items.groupBy("grp").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return out.select("grp", F.explode(F.aggregate("all", zero, step, lambda s: s["ids"])).alias("id"))


def chunk_caps(chunks: DataFrame, files: int, each: int, total: int) -> DataFrame:
    """At most ``each`` chunks of at most ``files`` files and ``total`` in all for each group, best first."""
    rank = Window.partitionBy("grp", "path").orderBy(F.desc("score"), "id")
    out = chunks.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= each)
    best = out.withColumn("top", F.max("score").over(Window.partitionBy("grp", "path")))
    out = best.withColumn("f", F.dense_rank().over(Window.partitionBy("grp").orderBy(F.desc("top"), "path"))).where(F.col("f") <= files)
    out = out.withColumn("t", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "id"))).where(F.col("t") <= total)
    return out.drop("n", "top", "f", "t")


def citations(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(answer_id, path, first, last, valid): ``path:line[-line]`` in a text, valid where the file exists and has the lines."""
    found = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w./-]+\.\w+:\d+(?:-\d+)?"), 0))).alias("c"))
    found = found.select("answer_id", F.regexp_extract("c", r"^(.*):(\d+)", 1).alias("path"), F.regexp_extract("c", r":(\d+)", 1).cast("int").alias("first"), F.regexp_extract("c", r"-(\d+)$", 1).alias("l"))
    found = found.select("answer_id", "path", "first", F.when(F.col("l") == "", F.col("first")).otherwise(F.col("l").cast("int")).alias("last"))
    known = files.groupBy("path").agg(F.max("line_count").alias("lines"))
    out = found.join(known, "path", "left")
    return out.select("answer_id", "path", "first", "last", F.coalesce((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("lines")), F.lit(False)).alias("valid"))


def confidence_from_distance(found: DataFrame) -> DataFrame:
    """(grp, confidence) = int(40 + 55 / (1 + mean distance))."""
    return found.groupBy("grp").agg((40 + 55 / (1 + F.avg("distance"))).cast("int").alias("confidence"))


def best_chunk(found: DataFrame, k: int = 10) -> DataFrame:
    """(path, score): the greatest 1 / (1 + distance) of each file, three digits. A top-k report."""
    return found.groupBy("path").agg(F.round(F.max(1 / (1 + F.col("distance"))), 3).alias("score")).orderBy(F.desc("score"), "path").limit(k)


def jaccard_novelty(pairs: DataFrame) -> DataFrame:
    """Novelty of a text against another: -80 above a Jaccard similarity of 0.65, else 60."""
    a, b = text.token_set(F.col("a")), text.token_set(F.col("b"))
    union = F.size(F.array_union(a, b))
    sim = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
    return pairs.withColumn("similarity", sim).withColumn("novelty", F.when(F.col("similarity") > 0.65, -80).otherwise(60))


def page(df: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """One page in a stated order."""
    return df.orderBy(order).offset(offset).limit(limit)


def keyword_files(files: DataFrame, keywords: list[str], k: int = 10) -> DataFrame:
    """(path, score): the length of each keyword in the path, else of the base name inside a keyword, plus half for each part hit. A top-k report."""
    p = F.translate(F.lower("path"), "_.", "--")
    base = F.translate(F.regexp_replace(paths.file_name(F.lower("path")), r"\.[^.]*$", ""), "_", "-")
    score = F.lit(0)
    for w in keywords:
        v = w.lower().replace("_", "-").replace(".", "-")
        score = score + F.when(p.contains(v), len(w)).when((F.length(base) >= 4) & F.contains(F.lit(v), base), F.length(base)).otherwise(0)
        score = score + F.when(F.lower("path").contains(w.lower()), len(w) // 2).otherwise(0)
    return files.select("path").distinct().withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "path").limit(k)
