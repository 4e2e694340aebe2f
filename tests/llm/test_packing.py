"""Problem 7: nothing lost, nothing over capacity, little room left."""

from __future__ import annotations

import os
import random

import pytest

from quarrylight.llm import packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.RANKS), reason="the tokenizer's rank file is not here")


def texts(n=300):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    return [" ".join(rnd.choice(words[(i % 5) * 80 : (i % 5) * 80 + 90]) for _ in range(rnd.choice([3, 8, 20, 60, 200, 900]))) for i in range(n)]


def test_pack(spark):
    coder = packing.tokenizer(packing.RANKS)
    rows = [(i, t, "EN" if i % 2 else "en", 1) for i, t in enumerate(texts())] + [(900, None, "en", 1), (901, "", None, 1), (902, "lone", None, 1), (903, "twice", "en", 1), (903, "twice", "en", 1), (904, "漢字😀" * 400, "zh", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, tokens int")
    by = {r[0]: r[1] for r in rows}
    out = packing.pack(df, {"a": 128, "b": 512}, len(rows)).collect()
    for model, capacity in (("a", 128), ("b", 512)):
        mine = [x for x in out if x.model_name == model]
        load = {}
        for x in mine:
            load[x.container] = load.get(x.container, 0) + x.tokens
            assert x.tokens == len(coder.encode(by[x.doc_id][x.start : x.end]))
        assert max(load.values()) <= capacity
        pieces = {}
        for x in mine:
            pieces.setdefault(x.doc_id, set()).add((x.piece_no, x.start, x.end))
        assert set(pieces) == {d for d, t in by.items() if t}
        for d, p in pieces.items():
            ordered = sorted(p)
            assert "".join(by[d][a:b] for _, a, b in ordered) == by[d]
            assert (len(ordered) == 1) == (len(coder.encode(by[d])) <= capacity)
        assert sum(1 for x in mine if x.doc_id == 903) == 2
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    assert packing.pack(df.where("false"), {"a": 8}, 0).count() == 0 and packing.pack(df, {}, 5).count() == 0


def test_neighbours_come_first():
    index = packing.Index(["red apple pie recipe", "blue car engine oil", "green apple pie tart", "fast car engine parts", "x", "y", "z"])
    s = index.scores(0)
    assert s[2] > 0 and s[1] == s[3] == 0
