"""Set differences, merges and deduplication."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def manifest_diff(old: DataFrame, new: DataFrame, renames: bool = True) -> DataFrame:
    """(change, path, old_path) of two manifests (path, hash).

    change is added, modified, deleted, unchanged or renamed. The k-th deleted
    path of a hash pairs with the k-th added one, both in path order, so pairing
    does not depend on row order; without ``renames`` they stay added and deleted.
    Equal null hashes are unchanged; of repeated paths the least hash counts.
    """
    a = old.where("path is not null").groupBy("path").agg(F.min("hash").alias("h1"), F.lit(True).alias("o"))
    b = new.where("path is not null").groupBy("path").agg(F.min("hash").alias("h2"), F.lit(True).alias("n"))
    both = a.join(b, "path", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("h1").eqNullSafe(F.col("h2")), "unchanged").otherwise("modified")
    both = both.select("path", change.alias("change"), F.coalesce("h2", "h1").alias("hash"))
    if not renames:
        return both.select("change", "path", F.lit(None).cast("string").alias("old_path"))
    w = Window.partitionBy("change", "hash").orderBy("path")
    moved = both.where("change in ('added', 'deleted')").withColumn("k", F.row_number().over(w))
    pair = moved.groupBy("hash", "k").agg(F.max(F.when(F.col("change") == "added", F.col("path"))).alias("to"), F.max(F.when(F.col("change") == "deleted", F.col("path"))).alias("from"))
    pair = pair.where("hash is not null or (to is null or from is null)")
    renamed = pair.select(
        F.when(F.col("to").isNotNull() & F.col("from").isNotNull(), "renamed").when(F.col("from").isNull(), "added").otherwise("deleted").alias("change"),
        F.coalesce("to", "from").alias("path"),
        F.when(F.col("to").isNotNull(), F.col("from")).alias("old_path"),
    )
    return both.where("change in ('modified', 'unchanged')").select("change", "path", F.lit(None).cast("string").alias("old_path")).unionByName(renamed)


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Breaking changes of public symbols (file_path, qualified, name, visibility, param_count).

    Result: (kind, name, file_path, severity). A removed symbol whose bare name was
    added elsewhere is ``moved``; a loss of visibility is reported beside the removal.
    """
    key = ["file_path", "qualified"]
    a = before.where("visibility = 'PUBLIC'").dropDuplicates(key)
    b = after.where("visibility = 'PUBLIC'").dropDuplicates(key)
    removed, added = a.join(b.select(*key), key, "left_anti"), b.join(a.select(*key), key, "left_anti")
    moved = removed.join(added.select("name").distinct(), "name", "left_semi")
    shared = a.join(b.select(*key, F.col("param_count").alias("p2")), key).where("param_count > 0 and param_count <> p2")
    hidden = a.join(after.where("visibility in ('PRIVATE', 'INTERNAL')").select(*key).distinct(), key, "left_semi")

    def rows(df: DataFrame, kind: str, severity: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "name", "file_path", F.lit(severity).alias("severity"))

    gone = removed.join(moved.select(*key), key, "left_anti")
    parts = [rows(moved, "moved", "medium"), rows(gone, "removed", "high"), rows(shared, "signature_changed", "high"), rows(hidden, "visibility_reduced", "high")]
    return reduce(DataFrame.unionByName, parts)


def graph_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(side, src, dst) edges that only one of two versions has."""
    gone = old.select("src", "dst").distinct().exceptAll(new.select("src", "dst").distinct()).withColumn("side", F.lit("removed"))
    come = new.select("src", "dst").distinct().exceptAll(old.select("src", "dst").distinct()).withColumn("side", F.lit("added"))
    return gone.unionByName(come)


def degree_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, before, after, delta) of total degrees that changed."""

    def degree(e: DataFrame, name: str) -> DataFrame:
        return e.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias(name))

    out = degree(old, "before").join(degree(new, "after"), "node", "full").select("node", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def merge_delta(nodes: DataFrame, edges: DataFrame, touched: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, path) and edges (src, dst) after an update.

    Nodes on touched paths leave, new ones come and win over old ones of one id,
    and edges stay where both ends do.
    """
    kept = nodes.join(touched.select("path").distinct(), "path", "left_anti").join(new_nodes.select("id"), "id", "left_anti").select("id", "path")
    all_nodes = kept.unionByName(new_nodes.select("id", "path")).dropDuplicates(["id"])
    ids = all_nodes.select("id")
    every = edges.select("src", "dst").unionByName(new_edges.select("src", "dst")).distinct()
    every = every.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return all_nodes, every


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def text_key(text: "F.Column") -> "F.Column":
    """MD5 of a text without outer white space of any kind."""
    return F.md5(F.regexp_replace(text, r"^\s+|\s+$", ""))


#: Findings of one group that a greedy merge compares in one task, at most.
MOST_IN_GROUP = 20_000


def fuzzy_merge(findings: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Greedy merge of findings (category, ord, text, severity, confidence) of one category.

    A finding whose text has a matching-block ratio, without case, of at least ``ratio``
    with an earlier kept one joins the first such; severity and confidence take the
    greater value, count the number. The order matters, so a category is one
    task; a larger category than MOST_IN_GROUP is an error and must be split by key.
    """

    def merge(part):
        if len(part) > MOST_IN_GROUP:
            raise ValueError(f"{len(part)} findings of one category; split it")
        kept: list[list] = []
        for r in part.sort_values(["ord", "text"]).itertuples(index=False):
            for k in kept:
                m = difflib.SequenceMatcher(None, k[2].lower(), r.text.lower())
                if m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio:
                    k[3], k[4], k[5] = max(k[3], r.severity), max(k[4], r.confidence), k[5] + 1
                    break
            else:
                kept.append([r.category, r.ord, r.text, r.severity, r.confidence, 1])
        return pd.DataFrame(kept, columns=["category", "ord", "text", "severity", "confidence", "count"])

    out = "category string, ord long, text string, severity int, confidence double, count int"
    return findings.select("category", "ord", "text", "severity", "confidence").dropna(subset=["category", "text"]).groupBy("category").applyInPandas(merge, out)


def conflicts(items: DataFrame) -> DataFrame:
    """(id, conflict, cause, members): recommendations (id, category, entities) that touch others.

    A shared entity makes a file_collision; an item without one shares the
    ownership of a module with others of its category, security or architecture.
    An item is listed once for each cause with the number of items the cause
    joins, which says the same as all pairs and stays linear.
    """
    e = items.select("id", F.explode(F.array_distinct("entities")).alias("cause"))
    shared = e.groupBy("cause").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    hit = e.join(shared, "cause").select("id", F.lit("file_collision").alias("conflict"), "cause", "members")
    same = items.where("category in ('security', 'architecture')").select("id", F.col("category").alias("cause"))
    owned = same.groupBy("cause").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    other = same.join(owned, "cause").join(hit.select("id").distinct(), "id", "left_anti")
    return hit.unionByName(other.select("id", F.lit("module_ownership").alias("conflict"), "cause", "members"))
