"""Questions, knowledge graphs, findings and context assembly."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylight import api
from quarrylight.operators import calls, context, knowledge
from quarrylight.sources import parse

SYMBOL = "repository_id string, commit_sha string, moniker string, name string, qualified string, kind string, path string, start int, end int, parent string"
RELATION = "repository_id string, commit_sha string, source string, target string, kind string, path string, line int"


@pytest.fixture(scope="module")
def facts(spark):
    s = [("r", "c", "m:a", "run", "A.run", "method", "a.py", 3, 9, "A"), ("r", "c", "m:b", "helper", "helper", "function", "b.py", 1, 2, None), ("r", "c", "m:c", "run", "run", "function", "c.py", 5, 4, None), ("r", "d", "m:a", "run", "A.run", "method", "a.py", 3, 9, "A")]
    r = [("r", "c", "m:a", "m:b", "CALLS", "a.py", 4), ("r", "c", "m:c", "m:b", "CALLS", "c.py", 6), ("r", "c", "m:a", "os", "IMPORTS", "a.py", 1), ("r", "c", "m:b", "m:zz", "REFERENCES", "b.py", 2)]
    return api.Facts(spark.createDataFrame(s, SYMBOL), spark.createDataFrame(r, RELATION), "r", "c")


def test_questions(facts):
    assert [x.moniker for x in api.Plan("GO_TO_DEFINITION", " run ").run(facts).collect()] == ["m:a", "m:c"]
    assert [x.source for x in api.Plan("FIND_CALLERS", "m:b").run(facts).collect()] == ["m:a", "m:c"]
    assert [x.target for x in api.Plan("FIND_CALLEES", "m:a").run(facts).collect()] == ["m:b"]
    assert [x.target for x in api.Plan("FIND_REFERENCES", "m:b").run(facts).collect()] == ["m:zz"]
    assert [x.target for x in api.Plan("FIND_IMPORTS", "a.py").run(facts).collect()] == ["os"]
    assert api.Plan("FIND_CALLERS", "m:b", 0).run(facts).count() == 1  # a limit is at least 1
    assert [x.symbol_id for x in api.Plan("SYMBOL_SEARCH", "help").run(facts).collect()] == ["m:b"]
    assert [x.moniker for x in api.symbol_lookup(facts, "A.run", "a.py").collect()] == ["m:a"]
    assert {tuple(x) for x in api.consistency(facts).collect()} == {("unknown_target", "m:zz"), ("span", "m:c")}
    with pytest.raises(ValueError):
        api.Plan("TELL_JOKE", "x").run(facts)


def test_intents_and_entities(spark):
    rows = [("Who calls `parse_file()` in src/a.py?",), ("How healthy is TokenScanner?",), (None,)]
    df = spark.createDataFrame(rows, "q string").select(api.intent(F.col("q")).alias("i"), api.entities(F.col("q")).alias("e"))
    assert [(x.i, x.e) for x in df.collect()] == [("callers", ["parse_file", "parse_file()", "src/a.py"]), ("health", ["TokenScanner"]), (None, None)]


def test_knowledge_graph(spark):
    files = spark.createDataFrame([("g", "a/b/x.py", "python", "class A:\n    def f(self):\n        pass\n"), ("g", "y.py", "python", "import os\n")], "g string, path string, language string, content string")
    f = parse.extract_facts(files)
    edges = spark.createDataFrame([("g", "y.py", "a/b/x.py"), ("g", "y.py", "gone.py")], "g string, src string, dst string")
    n, e = knowledge.knowledge_graph({"files": files, "facts": f, "file_edges": edges})
    assert {(x.src, x.dst, x.kind) for x in e.collect()} == {
        ("repository:g", "directory:a", "CONTAINS"),
        ("directory:a", "directory:a/b", "CONTAINS"),
        ("directory:a/b", "file:a/b/x.py", "CONTAINS"),
        ("repository:g", "file:y.py", "CONTAINS"),
        ("file:a/b/x.py", "symbol:a/b/x.py#A", "DECLARES"),
        ("symbol:a/b/x.py#A", "symbol:a/b/x.py#A.f", "DECLARES"),
        ("file:y.py", "file:a/b/x.py", "IMPORTS"),
    }
    changed = spark.createDataFrame([("g", "file:a/b/x.py")], "g string, id string")
    assert {(x.kind, x.edges, x.nodes) for x in knowledge.ripple(e, changed).collect()} == {("CONTAINS", 1, 1), ("DECLARES", 1, 1), ("IMPORTS", 1, 1)}
    assert n.count() == 7


def test_findings_and_recommendations(spark):
    files = spark.createDataFrame([("g", "src/a.py", 200_000), ("h", "README.md", 10), ("h", "tests/test_a.py", 1), ("h", "tests/test_b.py", 1), ("h", "tests/test_c.py", 1)], "g string, path string, size_bytes long")
    found = knowledge.inspection([knowledge.large_file_findings(files), knowledge.documentation_findings(files), knowledge.testing_findings(files)])
    assert {(x.g, x.category, x.severity) for x in found.collect()} == {("g", "performance", "low"), ("g", "documentation", "medium"), ("g", "testing", "high")}
    steps = {x.category: x.step for x in knowledge.recommendations(found).collect()}
    assert sorted(steps.values()) == [1, 2, 3] and steps["testing"] == 1


def test_context_expansion_and_package(spark, facts):
    seeds = spark.createDataFrame([("m:b",)], "moniker string")
    items = context.retrieve("explain", seeds, facts)
    assert {(x.id, x.kind, x.priority) for x in items.collect()} == {("m:b", "definition", 1), ("m:zz", "references", 2), ("m:a", "calls", 3), ("m:c", "calls", 3)}
    contents = spark.createDataFrame([("m:b", "x" * 40), ("m:a", "y" * 400), ("m:c", "z" * 20)], "id string, content string")
    out = context.context_package(items.withColumn("grp", F.lit("q")), contents, 16).first().json
    assert "m:b" in out and "m:c" in out and "m:a" not in out


def test_ordered_traversals(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "a", "c"), ("g", "b", "d"), ("g", "d", "a"), ("g", "c", "d")], "g string, src string, dst string")
    s = spark.createDataFrame([("g", "a")], "g string, start string")
    assert [x.node for x in calls.depth_first(e, s).orderBy("ord").collect()] == ["a", "b", "d", "c"]
    scored = spark.createDataFrame([("g", "a", 1.0, True), ("g", "b", 2.0, False), ("g", "c", 5.0, False), ("g", "d", 3.0, False), ("g", "z", 9.0, False)], "g string, node string, score double, entry boolean")
    assert [x.node for x in calls.best_first(e, scored).orderBy("ord").collect()] == ["z", "a", "c", "d", "b"]


def test_partial_call_graph_equals_full(spark):
    schema = "g string, path string, caller string, callee string, name string, line int"
    old = spark.createDataFrame([("g", "a", "f", "h1", "h", 1), ("g", "b", "k", "h1", "h", 2), ("g", "b", "k", "m", "m", 3)], schema)
    new = [("g", "a", "f", "q", "q", 1), ("g", "b", "k", "h2", "h", 2), ("g", "b", "k", "m", "m", 3)]
    out = calls.partial_call_graph(old, spark.createDataFrame(new, schema), spark.createDataFrame([("g", "a")], "g string, path string"), spark.createDataFrame([("g", "h")], "g string, name string"))
    assert {tuple(x) for x in out.collect()} == set(new)
