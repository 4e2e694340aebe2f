"""Churn, differences, ranking and scores on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import paths, text
from quarrylight.operators import diff, history, resolve, scoring, search
from quarrylight.sources import files, parse
from quarrylight.streaming import monitor

LOG = """COMMIT|h1|alice|2024-06-01T10:00:00+00:00
M\tservices/auth.py
M\tmodels/user.py
COMMIT|h2|bob|2024-06-02T10:00:00+00:00
M\tservices/auth.py
A\tfrontend/login.tsx
COMMIT|h3|alice|2024-06-03T10:00:00+00:00
M\tservices/auth.py
D\tdocs/old_readme.md
COMMIT|h4|carol|2024-06-04T10:00:00+00:00
R100\tmodels/old_user.py\tmodels/user_v2.py"""


def touches(spark):
    lines = [("log", i, s) for i, s in enumerate(LOG.split("\n"))]
    return history.parse_git_log(spark.createDataFrame(lines, "log string, line_no int, line string"))


def test_churn_of_a_log(spark):
    got = {x.path: (x.commits, x.score, x.primary_author, x.authors, x.bus_factor_risk, x.is_deleted) for x in history.churn(touches(spark)).collect()}
    assert got == {
        "services/auth.py": (3, 100.0, "alice", 2, False, False),
        "models/user.py": (1, 33.33, "alice", 1, True, False),
        "frontend/login.tsx": (1, 33.33, "bob", 1, True, False),
        "docs/old_readme.md": (1, 33.33, "alice", 1, True, True),
        "models/user_v2.py": (1, 33.33, "carol", 1, True, False),
    }
    weeks = {str(x.week): (x.commits, x.files, x.authors) for x in history.weekly(touches(spark)).collect()}
    assert weeks == {"2024-05-27": (2, 3, "alice,bob"), "2024-06-03": (2, 3, "alice,carol")}
    assert history.churn(touches(spark).where("false")).count() == 0


def test_manifest_diff_pairs_renames_in_order(spark):
    m = "path string, hash string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", None), (None, "9")], m)
    new = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1"), ("c", "3"), ("d", None)], m)
    got = {(x.change, x.path, x.old_path) for x in diff.manifest_diff(old, new).collect()}
    assert got == {("renamed", "x", "a"), ("renamed", "y", "b"), ("added", "z", None), ("modified", "c", None), ("unchanged", "d", None)}
    mirror = {(x.change, x.path) for x in diff.manifest_diff(new, old, renames=False).collect()}
    assert mirror == {("deleted", "x"), ("deleted", "y"), ("deleted", "z"), ("added", "a"), ("added", "b"), ("modified", "c"), ("unchanged", "d")}


def test_merge_delta_keeps_edges_with_both_ends(spark):
    nodes = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, path string")
    edges = spark.createDataFrame([("1", "2")], "src string, dst string")
    n, e = diff.merge_delta(nodes, edges, spark.createDataFrame([("b",)], "path string"), spark.createDataFrame([("3", "c")], "id string, path string"), spark.createDataFrame([("1", "3"), ("3", "9")], "src string, dst string"))
    assert {x.id for x in n.collect()} == {"1", "3"} and [tuple(x) for x in e.collect()] == [("1", "3")]


def test_paths_and_layers(spark):
    rows = [("src/app.py", "production", "Python"), ("tests/test_a.py", "test", "Python"), ("docs/x.md", "docs", "Markdown"), ("package.json", "config", "JSON"), ("node_modules/a/b.js", "generated", "JavaScript"), ("examples/x.go", "example", "Go"), ("LICENSE", "docs", "Unknown"), ("a/b_pb2.py", "generated", "Python"), ("", "production", "Unknown"), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "path string")
    got = df.select("path", paths.category(F.col("path")).alias("c"), paths.language(F.col("path")).alias("l")).collect()
    assert [tuple(x) for x in got] == rows
    assert df.limit(1).select(paths.is_ignored(F.lit("Pkg/Migrations/0001.PY"), ["migrations/"])).first()[0]
    assert not df.limit(1).select(paths.is_ignored(F.lit("pkg/a.py"), ["*.js", "b?.py"])).first()[0]


def test_search_ranks_in_tiers(spark):
    s = spark.createDataFrame([(1, "parse", "m.parse", "a.py"), (2, "Parser", "m.Parser", "a.py"), (3, "PathSet", "m.PathSet", "a.py"), (4, "unparse", "m.unparse", "a.py"), (5, "zzz", "m.zzz", "parse.py"), (6, "q", "q", "q")], "symbol_id int, name string, qualified string, path string")
    assert [(x.symbol_id, x.kind) for x in search.rank_symbols(s, " parse ").collect()] == [(1, "EXACT"), (2, "PREFIX"), (4, "SUBSTRING"), (5, "FILE_PATH")]
    assert [x.symbol_id for x in search.rank_symbols(s, "PS").collect()][0] == 3


def test_budgets(spark):
    items = spark.createDataFrame([("q", "a", 1, 60, 3.0), ("q", "b", 2, 50, 2.0), ("q", "c", 3, 30, 1.0)], "grp string, id string, priority int, tokens int, weight double")
    assert {x.id for x in search.greedy_budget(items, 100).collect()} == {"a", "c"}
    assert {x.id for x in search.prefix_budget(items, 100).collect()} == {"a"}
    assert {x.id for x in search.greedy_budget(items, 50).collect()} == {"a"}  # a first item too big stays alone


def test_scores(spark):
    one = spark.range(1)
    h = scoring.health(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(1), F.lit(5))
    assert one.select(*[v.alias(k) for k, v in h.items()]).first().asDict() == {"architecture": 100.0, "api": 100.0, "hygiene": 100.0, "churn": 100.0, "readability": 100.0, "overall": 100.0, "grade": "A"}
    t = "if a:\n  x\nelif b && c:\n  y\n"
    m = scoring.module_metrics(spark.createDataFrame([("p", t, 1, 3)], "path string, content string, fan_in int, fan_out int")).first()
    assert (m.lines, m.complexity, m.instability) == (4, 1 + 2 + 1 + 1, 0.75)


def test_parse_and_resolve(spark):
    src = [
        ("g", "pkg/a.py", "python", "from pkg.b import helper as h\nimport pkg.b\n\nclass A(Base):\n    def run(self, x):\n        self.go()\n        h(x)\n        return len(x)\n    def go(self):\n        pass\n"),
        ("g", "pkg/b.py", "python", "def helper(x):\n    return x\n\nclass Base:\n    def go(self):\n        pass\n    def stop(self):\n        pass\n"),
        ("g", "web/x.ts", "typescript", "import { y } from './y';\nexport function f(a: number) {\n  return y(a);\n}\n"),
        ("g", "web/y.ts", "typescript", "export const y = (a) => a;\n"),
        ("g", "bad.py", "python", "def ("),
        ("g", "null.py", "python", None),
    ]
    df = spark.createDataFrame(src, "g string, path string, language string, content string")
    f = parse.extract_facts(df)
    assert {(x.path, x.kind) for x in f.where("fact = 'error'").collect()} == {("bad.py", "SyntaxError")}
    assert {(x.src, x.dst) for x in resolve.file_edges(f, df).collect()} == {("pkg/a.py", "pkg/b.py"), ("web/x.ts", "web/y.ts")}
    calls = {(x.caller, x.callee): (x.target_path, x.target, x.tier) for x in resolve.resolve_calls(f, df).collect()}
    assert calls[("A.run", "go")] == ("pkg/a.py", "A.go", "own_class")
    assert calls[("A.run", "h")] == ("pkg/b.py", "helper", "import_symbol")
    assert calls[("A.run", "len")] == (None, None, None)
    assert calls[("", "y")] == ("web/y.ts", "y", "import_symbol")
    inherited = {(x["class"], x.method): (x.from_class, x.distance) for x in resolve.inherited_methods(f).where("class = 'A'").collect()}
    assert inherited == {("A", "run"): ("A", 0), ("A", "go"): ("A", 0), ("A", "stop"): ("Base", 1)}


def test_line_chunks_cover_all_lines(spark):
    body = "\n".join(f"line {i} " + "x" * (i % 40) for i in range(300))
    df = spark.createDataFrame([("g", "p", body), ("g", "e", ""), ("g", "n", None)], "g string, path string, content string")
    rows = parse.line_chunks(df, 400, 80).orderBy("chunk_id").collect()
    assert all(len(x.content) <= 400 for x in rows) and rows[0].start_line == 1 and rows[-1].end_line == 300
    assert all(b.start_line <= a.end_line + 1 and b.end_line > a.end_line for a, b in zip(rows, rows[1:]))
    lines = body.split("\n")
    assert all(x.content == "\n".join(lines[x.start_line - 1 : x.end_line]) for x in rows)


def test_facts_sink_replaces_a_commit(spark, tmp_path):
    schema = "repository_id string, commit_sha string, k string, v int"
    where = str(tmp_path / "facts")
    files.write_facts(spark.createDataFrame([("r", "a", "x", 1), ("r", "a", "x", 2), ("r", "b", "y", 1)], schema), where, ["repository_id", "commit_sha", "k"])
    files.write_facts(spark.createDataFrame([("r", "a", "z", 9)], schema), where, ["repository_id", "commit_sha", "k"])
    assert {(x.commit_sha, x.k, x.v) for x in files.read_facts(spark, where, "r").collect()} == {("a", "z", 9), ("b", "y", 1)}
    files.delete_facts(spark, where, "r", "a")
    assert {x.commit_sha for x in spark.read.parquet(where).collect()} == {"b"}


def test_tree_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 'é'\n", encoding="utf-8")
    (tmp_path / "src" / "b.png").write_bytes(b"\x89")
    (tmp_path / "node_modules" / "c.js").write_text("1")
    got = files.scan_tree(spark, str(tmp_path)).collect()
    assert [(x.path, x.content, x.size_bytes) for x in got] == [("src/a.py", "x = 'é'\n", 9)]
    with pytest.raises(ValueError):
        files.scan_tree(spark, str(tmp_path), max_bytes=3)


def test_stage_plan():
    stages = {"symbols": [], "graph": ["symbols"], "report": ["graph"]}
    assert monitor.build_plan(stages, False, True, True, True) == dict.fromkeys(stages, "SKIP")
    assert monitor.build_plan(stages, True, True, True, True) == dict.fromkeys(stages, "PARTIAL")
    assert monitor.build_plan(stages, False, False, True, True) == dict.fromkeys(stages, "FULL")
    with pytest.raises(ValueError):
        monitor.build_plan({"a": ["b"], "b": ["a"]}, True, True, True, True)


def test_fuzzy_merge_and_conflicts(spark):
    f = spark.createDataFrame([("c", 1, "missing docs in module a", 2, 0.5), ("c", 2, "missing docs in module b", 4, 0.4), ("c", 3, "circular import", 1, 0.9), (None, 4, "x", 1, 0.1)], "category string, ord long, text string, severity int, confidence double")
    assert {(x.text, x.severity, x["count"]) for x in diff.fuzzy_merge(f).collect()} == {("missing docs in module a", 4, 2), ("circular import", 1, 1)}
    i = spark.createDataFrame([(1, "security", ["a", "b"]), (2, "style", ["b"]), (3, "security", ["z"])], "id int, category string, entities array<string>")
    assert {(x.id, x.conflict, x.cause, x.members) for x in diff.conflicts(i).collect()} == {(1, "file_collision", "b", 2), (2, "file_collision", "b", 2), (3, "module_ownership", "security", 2)}


def test_text_functions(spark):
    df = spark.createDataFrame([("  `Where` is   FOO? ",), (None,)], "q string")
    assert [x[0] for x in df.select(text.normalised_query(F.col("q"))).collect()] == ["where is foo", None]
    assert df.limit(1).select(text.redacted(F.lit("key ghp_abcdefghijklmnopqrstuv and password=hunter2x"))).first()[0] == "key [REDACTED] and password=[REDACTED]"
    assert df.limit(1).select(text.declared_all(F.lit("__all__ = ['a', \"b\"]"))).first()[0] == ["a", "b"]
