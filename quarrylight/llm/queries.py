"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import leakage, neighbours, packing, personal, provenance, split, syntax
from quarrylight.storage import broadcast_if_small, materialize, rows_of, table

#: Rows up to which a table of settings or evaluation tasks is read to the driver.
SETTINGS = 100_000


def small_table(df: DataFrame, limit: int = SETTINGS) -> list:
    """All rows of a table that must be small; more rows than ``limit`` are an error, never cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows where a small table was expected")
    return rows


def split_rules(spark: SparkSession, folder: str) -> list[split.SplitRule]:
    models = table(spark, folder, "embedding_model").select("model_name", "model_version", "max_chars", "overlap_chars")
    return [split.SplitRule(*r) for r in sorted(small_table(models))]


def counting_units(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The file units that count: of each key the latest delivery."""
    key = ["repository_id", "commit_sha", "path"]
    units = table(spark, folder, "ria_file_unit").select(*key, *columns, "delivered_at")
    best = F.max(F.struct("delivered_at", *columns)).alias("best")
    return units.groupBy(*key).agg(best).select(*key, *[f"best.{c}" for c in columns])


def invalid_units(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(units, bad): file units of checked languages with a fetched body, and those whose body is not valid.

    Each distinct body is parsed once for each language it is used under; the
    bodies are moved once, by their unique key, so that copies make no hot key.
    """
    files = table(spark, folder, "source_files").where("content is not null")
    units = counting_units(spark, folder, "language", "content_hash").where(F.col("language").isin(*syntax.PARSERS))
    units = materialize(units, "units")
    firsts = files.groupBy("content_hash").agg(F.min("repository_id").alias("repository_id"))
    wanted = units.select("content_hash", "language").distinct().join(firsts, "content_hash")
    bodies = files.select("repository_id", "content_hash", "content").join(wanted, ["repository_id", "content_hash"])
    bad = materialize(syntax.invalid_bodies(bodies).distinct(), "invalid")
    units = units.join(files.select("repository_id", "content_hash"), ["repository_id", "content_hash"], "left_semi")
    return units, units.join(broadcast_if_small(bad, bad.count()), ["language", "content_hash"], "left_semi")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """File units whose body is not valid in the language they name."""
    return invalid_units(spark, folder)[1].select("repository_id", "commit_sha", "path")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each repository and language: file units, those that do not parse, and their share."""
    units, bad = invalid_units(spark, folder)
    by = ["repository_id", "language"]
    counts = units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"))
    wrong = bad.groupBy(*by).agg(F.count(F.lit(1)).alias("invalid"))
    return counts.join(wrong, by, "left").select(*by, "units", F.coalesce("invalid", F.lit(0)).alias("invalid"), (F.coalesce("invalid", F.lit(0)) / F.col("units")).alias("rate"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies that come out in pieces, for each model."""
    pieces = split.split_items(table(spark, folder, "source_files"), split_rules(spark, folder))
    return pieces.where("piece_no = 1").select("model_name", "repository_id", "content_hash").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized body, with its key in the embedding cache and whether that is cached."""
    pieces = split.split_items(table(spark, folder, "source_files"), split_rules(spark, folder))
    cached = table(spark, folder, "embedding_cache").select("chunk_hash").distinct().withColumn("cached", F.lit(True))
    return pieces.join(cached, "chunk_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def cached_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, id, v): usable vectors of the rows that count, grp being the model."""
    cache = table(spark, folder, "embedding_cache").select("chunk_hash", "model_name", "embedding", "updated_at")
    latest = cache.groupBy("chunk_hash").agg(F.max(F.struct("updated_at", "model_name", "embedding")).alias("r"))
    rows = latest.select(F.col("r.model_name").alias("grp"), F.col("chunk_hash").alias("id"), F.col("r.embedding").alias("embedding"))
    dims = table(spark, folder, "embedding_model").select(F.col("model_name").alias("grp"), "dims")
    return neighbours.usable_vectors(rows, dims)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of one model, one among the 10 most similar of the other, with a cosine of 0.9 or more."""
    near = neighbours.nearest(cached_vectors(spark, folder), materialize, k=10, min_similarity=0.9)
    near = near.where("similarity >= 0.9")
    pair = near.select(F.col("grp").alias("model_name"), F.least("id", "neighbour").alias("chunk_hash_a"), F.greatest("id", "neighbour").alias("chunk_hash_b"))
    return pair.distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar chunks of every usable vector under its model, however similar they are."""
    near = neighbours.nearest(cached_vectors(spark, folder), materialize, k=10)
    return near.select(F.col("grp").alias("model_name"), F.col("id").alias("chunk_hash"), "neighbour", "similarity", "place")


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """File units that were not written by hand in their repository, and why."""
    units = materialize(counting_units(spark, folder, "language", "content_hash"), "units")
    return provenance.not_by_hand(units, table(spark, folder, "source_files"), materialize, broadcast_if_small)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """File units that were not written by hand in their repository."""
    return p5_kinds(spark, folder).select("repository_id", "commit_sha", "path")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each text or piece of a text, for each model's window."""
    models = small_table(table(spark, folder, "embedding_model").select("model_name", "window_tokens"))
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", F.col("repository_id").alias("topic"))
    return packing.pack(documents, dict(sorted(tuple(r) for r in models)), documents.count())


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each model: containers, tokens in them and the share of room used."""
    capacity = table(spark, folder, "embedding_model").select("model_name", "window_tokens")
    packed = p7_packed(spark, folder).groupBy("model_name", "container").agg(F.sum("tokens").alias("tokens"))
    total = packed.groupBy("model_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(capacity, "model_name").withColumn("used", F.col("tokens") / (F.col("containers") * F.col("window_tokens")))


def passages(spark: SparkSession, folder: str) -> leakage.Passages:
    tasks = small_table(table(spark, folder, "impact_tasks").select("task_id", "change_description"))
    return leakage.Passages.build([tuple(r) for r in tasks])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation task, with the task."""
    return leakage.find_leaks(table(spark, folder, "documents"), passages(spark, folder)).select("doc_id", "task_id").distinct()


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that leaked into it."""
    return leakage.remove_leaks(table(spark, folder, "documents"), passages(spark, folder))


def known_names(spark: SparkSession, folder: str) -> personal.KnownNames:
    """All author and committer names, and a score fitted to bounded samples of them and of the words of commit messages."""
    commits = table(spark, folder, "ria_commit")
    full = commits.select(F.explode(F.array("author_name", "committer_name")).alias("w")).dropna().distinct()
    words = commits.select(F.explode(F.regexp_extract_all("message", F.lit(r"\p{L}{3,}"), 0)).alias("w")).distinct()

    def sample(df: DataFrame, most: int) -> list[str]:
        return [r[0] for r in df.orderBy(F.xxhash64("w"), "w").limit(most).collect()]

    def roles(batches):
        for batch in batches:
            pairs = [p for p in map(personal.name_words, batch["w"]) if p]
            yield pd.DataFrame([(p[0], True, False) for p in pairs] + [(p[1], False, True) for p in pairs], columns=["word", "given", "family"])

    listed = full.mapInPandas(roles, "word string, given boolean, family boolean").groupBy("word").agg(F.max("given").alias("given"), F.max("family").alias("family"))
    listed = materialize(listed, "names")
    names, ordinary = sample(full, personal.MOST_NAMES), sample(words, personal.MOST_WORDS)
    if rows_of(listed) > personal.MOST_HELD:
        return personal.KnownNames(personal.NameModel(names, ordinary), listed)
    held = listed.collect()
    return personal.KnownNames(personal.NameModel(names, ordinary, [r["word"] for r in held if r["given"]], [r["word"] for r in held if r["family"]]))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information in each document, once per distinct value."""
    found = personal.find_personal(table(spark, folder, "documents"), known_names(spark, folder))
    return found.select("doc_id", "pii_type", "pii_value").distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its personal information replaced by typed surrogates, keyed by the setting spark.quarrylight.surrogates.key."""
    key = spark.conf.get("spark.quarrylight.surrogates.key", "set your own key").encode()
    return personal.redact(table(spark, folder, "documents"), known_names(spark, folder), key)


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_kinds": p5_kinds, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_redacted": p9_redacted}

ORACLES = {
    "p3_found": """select distinct m.model_name, s.repository_id, s.content_hash from source_files s
        join embedding_model m on length(s.content) > m.max_chars""",
    "p4_found": """with live as (select * from (select *, row_number() over (partition by chunk_hash order by updated_at desc) rn from embedding_cache) where rn = 1),
      ok as materialized (select l.model_name, chunk_hash, embedding::double[] as e from live l join embedding_model m on m.model_name = l.model_name and len(l.embedding) = m.dims
        where len(list_filter(embedding, lambda x: isnan(x) or x is null)) = 0 and list_sum(list_transform(embedding, lambda x: x * x)) > 0),
      pairs as (select a.model_name, a.chunk_hash as a, b.chunk_hash as b, list_cosine_similarity(a.e, b.e) as s from ok a join ok b on a.model_name = b.model_name and a.chunk_hash <> b.chunk_hash),
      ranked as (select *, row_number() over (partition by model_name, a order by s desc, b) as n from pairs)
      select distinct model_name, least(a, b) as chunk_hash_a, greatest(a, b) as chunk_hash_b from ranked where n <= 10 and s >= 0.9""",
}
