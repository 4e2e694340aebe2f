"""Scans of source trees, tables of facts and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import paths

#: fixed values: extensions of the code-only scan
CODE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx"]
#: fixed values: extensions of binary files, which are passed over
BINARY_EXTENSIONS = ".png .jpg .jpeg .gif .ico .pdf .zip .gz .tar .jar .class .so .dll .exe .woff .woff2 .ttf .eot .mp3 .mp4 .bin".split()


def scan_tree(spark: SparkSession, root: str, code_only: bool = False, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, content, size_bytes, content_hash) of the text files under a folder.

    Ignored folders and binary extensions are passed over. With limits, a count
    over names and sizes (no contents are read) comes first and more is an error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", f"^(?:file:)?/*{_quoted(root.rstrip('/').lstrip('/'))}/", "")
    rows = raw.select(relative.alias("path"), "length", "content")
    ext = paths.extension(F.lower("path"))
    rows = rows.where(~paths.in_directory(F.lower("path"), paths.IGNORED_DIRS) & ~ext.isin(BINARY_EXTENSIONS) & paths.is_valid_relative(F.col("path")))
    if code_only:
        rows = rows.where(ext.isin(CODE_EXTENSIONS))
    if max_files is not None or max_bytes is not None:
        n = rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        if (max_files is not None and n["files"] > max_files) or (max_bytes is not None and n["bytes"] > max_bytes):
            raise ValueError(f"{n['files']} files of {n['bytes']} bytes exceed the limits")
    return rows.select("path", F.decode("content", "utf-8").alias("content"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in s)


def point_read(files: DataFrame, repository: str, commit: str, path: str) -> DataFrame:
    """One file at a commit; all three predicates reach the scan."""
    return files.where((F.col("repository_id") == repository) & (F.col("commit_sha") == commit) & (F.col("path") == path))


def read_facts(spark: SparkSession, folder: str, repository: str | None = None, commit: str | None = None) -> DataFrame:
    """A fact table, pruned to the partitions of a repository and commit."""
    out = spark.read.parquet(folder)
    if repository is not None:
        out = out.where(F.col("repository_id") == repository)
    if commit is not None:
        out = out.where(F.col("commit_sha") == commit)
    return out


def new_bodies(tree: DataFrame, stored: DataFrame) -> DataFrame:
    """Of the bodies of a tree (content_hash, ...) one for each hash that is not stored yet."""
    return tree.dropDuplicates(["content_hash"]).join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def write_facts(facts: DataFrame, folder: str, key: list[str]) -> None:
    """Replace the partitions of the commits in ``facts``; one row for each key, the greatest of the rest."""
    rest = [c for c in facts.columns if c not in key]
    best = facts.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, *[f"r.{c}" for c in rest]) if rest else facts.distinct()
    best.repartition("repository_id", "commit_sha").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id", "commit_sha").parquet(folder)


def delete_facts(spark: SparkSession, folder: str, repository: str, commit: str) -> None:
    """Drop the partition of a commit."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/repository_id={repository}/commit_sha={commit}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def publish_version(rows: DataFrame, folder: str, version: str) -> None:
    """Stage rows under a new version, then point readers at it; a failed stage leaves the old version in place."""
    spark = rows.sparkSession
    rows.where("content is not null and trim(content) <> ''").write.mode("overwrite").parquet(f"{folder}/version={version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_current")


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The published version."""
    version = spark.read.parquet(f"{folder}/_current").first()["version"]
    return spark.read.parquet(f"{folder}/version={version}")


def without_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks but those of the given files."""
    return chunks.join(files.select("path").distinct(), "path", "left_anti")


def cache_misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Different keys (chunk_hash) without a cached row, the only ones to compute."""
    return keys.select("chunk_hash").distinct().join(cache.select("chunk_hash").distinct(), "chunk_hash", "left_anti")


def subgraph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, json) of small graphs for display; cut to size before with an ordered limit."""
    n = nodes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "category"))).alias("nodes"))
    e = edges.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    return n.join(e, "g", "left").select("g", F.to_json(F.struct("nodes", "edges")).alias("json"))


def report_lines(report: DataFrame) -> DataFrame:
    """A report (section, name, value) as Markdown lines in order."""
    head = report.select("section").distinct().select("section", F.lit("").alias("name"), F.concat(F.lit("## "), "section").alias("line"))
    body = report.select("section", "name", F.format_string("- **%s**: %s", F.col("name"), F.col("value").cast("string")).alias("line"))
    return head.unionByName(body).orderBy("section", "name").select("line")


def entry_points(files: DataFrame) -> DataFrame:
    """(path, reason, priority): scripts named by package manifests first, then files by name.

    files: (path, content). The best reason of each path is kept.
    """
    manifest = files.where(F.lower(paths.file_name(F.col("path"))) == "package.json").select(paths.directory(F.col("path")).alias("dir"), F.get_json_object("content", "$.main").alias("main"))
    named = manifest.where("main is not null").select(F.regexp_replace(F.concat_ws("/", F.expr("nullif(dir, '')"), F.regexp_replace("main", r"^\./", "")), "^/", "").alias("path"), F.lit("manifest").alias("reason"), F.lit(1).alias("priority"))
    named = named.join(files.select("path").distinct(), "path", "left_semi")
    name = F.lower(paths.file_name(F.col("path")))
    code = files.where(~F.coalesce(paths.category(F.col("path")).isin("test", "generated"), F.lit(False)))
    by_name = F.when(name.isin("main.py", "__main__.py", "main.go", "main.rs", "main.tsx", "main.ts"), F.struct(F.lit("main"), F.lit(2))).when(name.isin("app.py", "application.py", "server.py", "api.py", "server.js", "app.js", "app.tsx"), F.struct(F.lit("server"), F.lit(3))).when(
        name.isin("manage.py", "wsgi.py", "asgi.py", "run.py", "cli.py"), F.struct(F.lit("runner"), F.lit(4))
    ).when(name.isin("index.js", "index.ts"), F.struct(F.lit("index"), F.lit(5)))
    found = code.select("path", by_name.alias("r")).where("r is not null").select("path", F.col("r")["col1"].alias("reason"), F.col("r")["col2"].alias("priority"))
    both = named.unionByName(found)
    return both.groupBy("path").agg(F.min_by("reason", "priority").alias("reason"), F.min("priority").alias("priority"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON documents (repository, key, subkey, data) written by :func:`write_documents`; data is one JSON text."""
    return spark.read.schema("repository string, key string, subkey string, data string").json(folder)


def write_documents(documents: DataFrame, folder: str) -> None:
    """Replace the documents of a folder; Spark publishes them with its job commit."""
    documents.select("repository", "key", "subkey", "data").write.mode("overwrite").json(folder)


def changed_files(request: DataFrame, tree: DataFrame) -> DataFrame:
    """Files of a pull request (path, status, additions, deletions) matched to a tree without case."""
    known = tree.select("path").distinct().select(F.lower("path").alias("k"), F.col("path").alias("tree_path"))
    return request.withColumn("k", F.lower("path")).join(known, "k", "left").drop("k")
