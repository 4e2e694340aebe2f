"""Problem 5: each kind of file that was not written by hand, and its look-alikes."""

from __future__ import annotations

import random

from quarrylight.llm import provenance
from quarrylight.storage import broadcast_if_small, materialize

WORDS = "scanner ledger planner broker canvas mirror tenant packet bundle cursor widget policy router digest shard filter".split()
UNIT = "repository_id string, commit_sha string, path string, language string, content_hash string, vendored string"


def hand(rnd, n=6):
    return "\n".join(f"export function {rnd.choice(WORDS)}{rnd.choice(WORDS).title()}{i}({rnd.choice(WORDS)}, {rnd.choice(WORDS)}) {{\n  const {rnd.choice(WORDS)}{rnd.choice(WORDS).title()} = {rnd.choice(WORDS)}({rnd.randrange(9999)}, '{rnd.choice(WORDS)} {rnd.randrange(999)}');\n  return {rnd.choice(WORDS)};\n}}" for i in range(n))


def table(spark):
    rnd = random.Random(2)
    body = {}
    for i in range(60):
        body[(f"r{i % 4}", f"src/m{i}.js")] = hand(rnd)
    copy = hand(rnd, 9)
    body[("r0", "src/util/x.js")] = copy
    body[("r1", "web/y.js")] = copy.replace("const", "let", 1)
    body[("r2", "vendor/libby/a.js")] = hand(rnd)
    body[("r2", "lib/b.js")] = "// libby v2.3.1\n// (c) the libby contributors. Released under the MIT licence.\n" + hand(rnd)
    body[("r3", "gen/c.js")] = "\n".join(f"export function getReducer{rnd.choice(WORDS)}{i}(m) {{\n  return m[{i}];\n}}" for i in range(12))
    letters = "abcdefghijklmnopqrstuvwxyz"
    body[("r3", "d.js")] = ";".join(f"function {rnd.choice(letters)}{i}({rnd.choice(letters)},{rnd.choice(letters)}){{return {rnd.choice(letters)}.{rnd.choice(WORDS)}({rnd.choice(letters)}||{i})}}" for i in range(60))
    body[("r3", "e.js")] = "export const table = [\n" + "\n".join(f"  [{rnd.randrange(999)}, {rnd.randrange(99999)}, {rnd.randrange(9)}]," for _ in range(80)) + "\n];\n"
    body[("r3", "mixed.js")] = "export const rows = [\n" + "\n".join(f"  [{rnd.randrange(999)}, {rnd.randrange(99999)}, \"{rnd.choice(WORDS)}\", true]," for _ in range(40)) + "\n];\n"
    body[("r0", "short.js")] = body[("r1", "lib/short.js")] = "// kept as is\nmodule.exports = require('./libby');\n"
    body[("r1", "vendor_portal/f.js")] = "const banner = '// Code generated by x. DO NOT EDIT.';\n" + hand(rnd)
    units = [(r, "c", p, "javascript", f"h{i}", "x") for i, (r, p) in enumerate(body)]
    files = [(r, f"h{i}", t) for i, ((r, p), t) in enumerate(body.items())]
    return units, files


def run(spark, units, files):
    u = spark.createDataFrame(units, UNIT)
    f = spark.createDataFrame(files, "repository_id string, content_hash string, content string")
    out = provenance.not_by_hand(u, f, materialize, broadcast_if_small).collect()
    return {x.path: {k for k in ("minified", "generated", "data", "vendored") if x[k]} for x in out}


def test_kinds(spark):
    units, files = table(spark)
    units += [("r0", "c", "null.js", "javascript", "hn", "x"), ("r0", "c", "lost.js", "javascript", "hz", "x"), ("r0", "c", "empty.js", "javascript", "he", "x"), ("r0", "c", "none.js", None, "he", "x")]
    files += [("r0", "hn", None), ("r0", "he", "")]
    assert run(spark, units, files) == {
        "src/util/x.js": {"vendored"},
        "web/y.js": {"vendored"},
        "vendor/libby/a.js": {"vendored"},
        "lib/b.js": {"vendored"},
        "gen/c.js": {"generated"},
        "d.js": {"minified"},
        "e.js": {"data"},
        "mixed.js": {"data"},
        "short.js": {"vendored"},
        "lib/short.js": {"vendored"},
    }


def test_empty(spark):
    assert run(spark, [], []) == {} and run(spark, table(spark)[0], []) == {}


def test_sketch_only_proposes(spark):
    """A body whose sketch lies in other repositories but whose runs do not is no copy; signs are reported apart."""
    rnd = random.Random(5)
    own = [hand(rnd, 12) for _ in range(3)]
    mixed = "\n".join([own[0], own[1]])  # half of it stands elsewhere
    rows = [("a", "1", own[0]), ("b", "2", own[0]), ("c", "3", mixed), ("d", "4", own[2])]
    bodies = spark.createDataFrame(rows, "repository_id string, content_hash string, content string")
    judged = provenance.features(bodies.selectExpr("*", "'javascript' as language")).selectExpr("*", "monotonically_increasing_id() as id")
    found = {r["repository_id"] for r in provenance.copied(bodies, materialize(judged), materialize, broadcast_if_small).collect()}
    assert found == {"a", "b"}


def test_style(spark):
    rows = [(i, "r", "python", 0, 12) for i in range(30)] + [(99, "r", "python", 12, 0), (100, "s", "python", 12, 0)]
    judged = spark.createDataFrame(rows, "id long, repository_id string, language string, camel int, snake int")
    assert [r["id"] for r in provenance.foreign_style(judged).collect()] == [99]
    assert provenance.style({"aB", "a_b", "AB_C", "plain"}) == (1, 1)


def test_upstream_headers():
    assert provenance.upstream("/*\n" + "licence text\n" * 200 + "*/\n// Copied verbatim from snowy 8.17.9. Keep in step\nx = 1") == "snowy"
    assert provenance.upstream("x = 1\n// Copied verbatim from snowy 8.17.9.") is None
    assert provenance.upstream("// Copied verbatim from snowy 8.17.9. Keep in step") == "snowy"
    assert provenance.upstream("# grum 9.2.0 - https://grum.example/x") == "grum"
    assert provenance.upstream("// borrowed idea from the vendor manual, written from scratch here") is None
    assert provenance.upstream("// Copyright the Northquay team. All rights reserved.") is None
