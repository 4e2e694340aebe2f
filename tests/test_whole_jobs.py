"""Queries do the whole job: no prefix, no subset, no single start."""

from __future__ import annotations

import hashlib

import numpy as np

from quarrylight.operators import search
from quarrylight.plans import QUERIES


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_fuzzy_merge_compares_whole_texts(spark, tmp_path):
    same = "the scanner drops the last token of a frozen index " * 6
    texts = {"a": same + "alpha " * 200, "b": same + "0123456789" * 120, "c": (same + "alpha " * 200).upper()}
    write(spark, tmp_path, "impact_tasks", [(k, "r", v) for k, v in texts.items()], "task_id string, repository string, change_description string")
    got = sorted((r.text.lower(), r["count"]) for r in QUERIES["u11_fuzzy_merge"](spark, str(tmp_path)).collect())
    assert len(same) > 300 and got == sorted([(texts["a"], 2), (texts["b"], 1)])


def test_cache_keys_of_all_bodies_of_one_piece(spark, tmp_path):
    write(spark, tmp_path, "embedding_model", [("m", "1", 900), ("n", "2", 5)], "model_name string, model_version string, max_chars int")
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    bodies = {"plain": " a\n", "long": "x y " * 200, "unicode": "\u00a0\u3000naïve 変数 \u0085", "edges": blanks + "\u200bq w\n\n" + blanks, "too long": "z" * 901, "five": "\U0001f600" * 5, "blank": " \t", "none": None}
    write(spark, tmp_path, "source_files", [("r", k, v) for k, v in bodies.items()], "repository_id string, content_hash string, content string")
    got = {(r.model_name, r.content_hash): r.chunk_hash for r in QUERIES["f02_cache_key"](spark, str(tmp_path)).collect()}
    want = {(m, k): hashlib.sha256(f"{m}:{v}:onnx:int8:{b.strip()}".encode()).hexdigest() for m, v, most in (("m", "1", 900), ("n", "2", 5)) for k, b in bodies.items() if b is not None and len(b) <= most}
    assert len(want) == 9 and got == want


def test_every_query_vector_is_searched_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "POINT_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    x = np.random.default_rng(3).standard_normal((160, 8)).astype(np.float32)
    x[77] = x[50]
    write(spark, tmp_path, "embeddings", [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(160, None, 0), (161, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    for name, far, digits in (("v02_nearest", np.maximum(0, 1 - u @ u.T), 4), ("v03_nearest_l2", ((y[:, None] - y[None]) ** 2).sum(2), 6)):
        got = {(r.query_id, r.vec_id): r.distance for r in QUERIES[name](spark, str(tmp_path)).collect()}
        d = np.round(far, digits)
        want = {(q, int(i)): d[q, i] for q in (0, 50, 100, 150) for i in np.lexsort((np.arange(160), d[q]))[:10]}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and got[50, 77] == 0


def test_searches_from_every_node_to_the_end(spark, tmp_path):
    rows = [("r", "c", f"e{i}", "calls", f"n{i}", f"n{(i + 1) % 9}", 1.0, 1) for i in range(9)] + [("r", "c", "x", "calls", "n8", "out", 1.0, 1)]
    write(spark, tmp_path, "ria_graph_edge", rows, "repository_id string, commit_sha string, edge_id string, kind string, source_id string, target_id string, weight double, delivered_at int")
    want = {(f"n{a}", f"n{b}", (b - a) % 9) for a in range(9) for b in range(9)} | {(f"n{a}", "out", 9 - a) for a in range(9)}
    got = {(r.start, r.node, r.depth) for r in QUERIES["g01_bfs"](spark, str(tmp_path)).collect()}
    assert got == want | {("out", "out", 0)}
    back = {(r.node, r.start, r.depth) for r in QUERIES["g02_reverse_bfs"](spark, str(tmp_path)).collect()}
    assert back == {x for x in want if x[0] != x[1]}


def test_visibility_takes_the_first_rule(spark):
    from quarrylight.operators import resolve

    base = {"g": "r", "path": "src/a.py", "name": "f", "kind": "function", "parent": None, "entry": None, "main_guard": None, "decorators": None, "nearby": None, "exported": None, "exports": None, "fan_in": None}
    cases = [
        ({"entry": True, "name": "_f"}, ("PUBLIC", "MAIN_ENTRY", 0.95, 1)),
        ({"name": "main", "main_guard": True}, ("PUBLIC", "MAIN_ENTRY", 0.90, 2)),
        ({"decorators": "router.post"}, ("PUBLIC", "ROUTE", 0.95, 3)),
        ({"path": "a.ts", "nearby": "app.get('/x', f)"}, ("PUBLIC", "ROUTE", 0.88, 4)),
        ({"decorators": "click.command"}, ("PUBLIC", "CLI_ENTRY", 0.90, 5)),
        ({"path": "a.js", "exported": True, "kind": "class"}, ("PUBLIC", "PUBLIC_CLASS", 0.95, 6)),
        ({"exported": True}, ("PUBLIC", "PUBLIC_FUNCTION", 0.95, 7)),
        ({"name": "__f"}, ("PRIVATE", "INTERNAL_HELPER", 0.90, 8)),
        ({"name": "_f"}, ("INTERNAL", "INTERNAL_HELPER", 0.88, 9)),
        ({"path": "a.js", "exports": 0}, ("INTERNAL", "INTERNAL_HELPER", 0.70, 10)),
        ({"path": "x/tests/a.go"}, ("INTERNAL", "INTERNAL_HELPER", 0.85, 11)),
        ({"path": "x/internal/a.go"}, ("PRIVATE", "INTERNAL_HELPER", 0.80, 12)),
        ({"path": "x/api/a.go"}, ("PUBLIC", "ROUTE", 0.75, 13)),
        ({"path": "a.ts", "kind": "enum", "exports": 1}, ("PUBLIC", "ENUM_TYPE", 0.70, 14)),
        ({}, ("PUBLIC", "PUBLIC_FUNCTION", 0.65, 15)),
        ({"path": "a.go", "kind": "method", "parent": "A"}, ("INTERNAL", "PUBLIC_METHOD", 0.60, 16)),
        ({"path": "a.go"}, ("UNKNOWN", "UNKNOWN", 0.0, 17)),
    ]
    rows = spark.createDataFrame([{**base, **c, "name": c.get("name", "f")} for c, _ in cases], "g string, path string, name string, kind string, parent string, " + resolve.VISIBILITY_INPUT)
    got = [(r.visibility, r.api_kind, r.confidence, r.rule) for r in resolve.visibility(rows).orderBy("rule").collect()]
    assert got == [want for _, want in cases]


def test_inheritance_has_no_depth(spark):
    from quarrylight.operators import resolve
    from quarrylight.sources.parse import FACTS

    rows = [("r", "a.py", "symbol", "class", f"C{i}", None, 1, 2, "") for i in range(20)] + [("r", "a.py", "base", "class", f"C{i}", None, 1, 1, f"C{i + 1}") for i in range(19)]
    rows += [("r", "a.py", "base", "class", "C19", None, 1, 1, "C0"), ("r", "a.py", "symbol", "method", "m", "C19", 1, 1, "")]
    got = {r["class"]: r.distance for r in resolve.inherited_methods(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {f"C{i}": 19 - i for i in range(20)}


def test_evidence_weights_by_kind(spark):
    from quarrylight.operators import knowledge

    kinds = ["LEVEL_1_EXACT_SYMBOL", "LEVEL_2_EXACT_CALL", "LEVEL_3_SYMBOL_DEPENDENCY", "LEVEL_4_API_CONTRACT", "LEVEL_5_TEST_RELATIONSHIP", "LEVEL_6_MODULE_DEPENDENCY", "LEVEL_7_HEURISTIC", "other"]
    rows = spark.createDataFrame([("r", k, k) for k in kinds], "g string, file string, kind string")
    got = {r.file: (r.score, r.tier) for r in knowledge.impact_tiers(rows).collect()}
    assert [got[k][0] for k in kinds] == [1.0, 0.95, 0.85, 0.80, 0.75, 0.5, 0.25, 0.25] and got[kinds[2]][1] == "HIGH" and got[kinds[3]][1] == "MEDIUM" and got["other"][1] == "LOW"


def test_hybrid_rank_by_its_formula(spark):
    question = "does the frozen scanner change src/a.py"
    rows = [("1", "src/a.py", "frozen scanner", 0.5), ("2", "tests/test_b.py", "frozen scanner of tests", 0.0), ("3", "lib/c.py", "nothing here", 0.1), ("4", "lib/d.py", "nothing here ", 0.0), ("5", "lib/e.py", "other", 0.3), ("6", "lib/e.py", "others", 0.2), ("7", "lib/e.py", "another", 0.4)]
    words = {"frozen", "scanner", "change", "src", "py"}
    want = {}
    for i, path, content, distance in rows:
        kind = 1e6 if path == "src/a.py" else 1e4 if path.startswith("tests") else 7e5
        share = len(words & set(content.split())) / len(words)
        total = kind + 1e4 / (1 + distance) + 5e3 * share + 1e3 / (len(path) + 1)
        want[i] = total * (0.3 if i == "7" else 1.0)  # the third chunk of its file by distance: max(0.3, 1 - 0.3 * 2) is 0.4
    want["7"] = want["7"] / 0.3 * max(0.3, 1 - 0.3 * 2)
    del want["3"]  # the text of 4, which ranks higher
    got = search.hybrid_rank(spark.createDataFrame(rows, "chunk_id string, path string, content string, distance double"), question, 10).collect()
    order = sorted(want, key=lambda i: (-want[i], i))
    assert [r.chunk_id for r in got] == order
    assert all(abs(r.total - want[r.chunk_id]) < 1e-3 for r in got), [(r.chunk_id, r.total, want[r.chunk_id]) for r in got]
