"""Null ids and further columns of clashing names in the document operators."""

from __future__ import annotations

import os

import pytest

from quarrylight.llm import leakage, packing, personal, syntax

ROWS = [(None, "mail a@b.example or Corvina Starbrook", "en", 1, 2), (9007199254740993, "plain words", None, 1, 2), (5, "x@y.example", "de", 1, 2)]
SCHEMA = "doc_id long, text string, lang string, start int, coverage int"


def test_personal_and_leaks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = personal.NameModel(["Corvina Starbrook"], ["mail"])
    got = {(x.doc_id, x.pii_value) for x in personal.find_personal(df, model).collect()}
    assert got == {(None, "a@b.example"), (None, "Corvina Starbrook"), (5, "x@y.example")}
    assert {x.doc_id for x in personal.redact(df, model, b"k").collect()} == {None, 9007199254740993, 5}
    passages = leakage.Passages.build([("t", "mail a b example or corvina starbrook")])
    assert [x.doc_id for x in leakage.find_leaks(df, passages).collect()] == [None]


@pytest.mark.skipif(not os.path.exists(packing.RANKS), reason="the tokenizer's rank file is not here")
def test_packing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {x.doc_id for x in packing.pack(df, {"m": 16}, 3).collect()} == {None, 9007199254740993, 5}


def test_syntax(spark):
    df = spark.createDataFrame([("json", None, "{", 1), ("json", "h", "{", 1)], "language string, content_hash string, content string, parent int")
    assert sorted((x.content_hash or "") for x in syntax.invalid_bodies(df).collect()) == ["", "h"]
