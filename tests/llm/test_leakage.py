"""Problem 8: planted passages in every disguise."""

from __future__ import annotations

import random

from quarrylight.llm import leakage

NOUNS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda omicron sigma tau upsilon phi chi psi omega quark lepton boson".split()


def passages(n=12):
    rnd = random.Random(4)
    return [(f"t{i}", "List every file affected by this change: " + " ".join(f"{rnd.choice(NOUNS)} {rnd.choice(NOUNS)}{rnd.randrange(90)}" for _ in range(22))) for i in range(n)]


def run(spark, docs, rows=None):
    p = leakage.Passages.build(passages() if rows is None else rows)
    df = spark.createDataFrame(docs, "doc_id long, text string, task_id string")
    return {(x.doc_id, x.task_id) for x in leakage.find_leaks(df, p).collect()}


def test_disguises(spark):
    t = dict(passages())
    w = t["t3"].split(": ")[1].split()
    edited = [x for i, x in enumerate(w) if i % 9 != 4]
    edited[7] = "other"
    edited.insert(15, "really")
    docs = [
        (1, "before " + t["t1"] + " after", "x"),
        (2, "\n".join("> " + x.upper() for x in t["t2"].split()), "x"),
        (3, "intro " + " ".join(edited) + " outro", "x"),
        (4, '{"prompt": "' + t["t4"].replace(" ", "\\n") + '"}', "x"),
        (5, "<p>" + " ".join(f"<b>{x}</b>" for x in t["t5"].split()) + "</p>", "x"),
        (6, " ".join(w[:8]) + " and nothing more", "x"),
        (7, "List every file affected by this change: something else", "x"),
        (8, " ".join(t["t6"].split()[10:26]), "x"),
        (9, "mentions t1 and t2 only", "x"),
        (10, None, "x"),
        (11, "", "x"),
        (12, ("noise words here. " * 20_000) + t["t7"] + " end", "x"),
        (13, "&quot;" + t["t8"].replace(" ", "&nbsp;") + "&quot;", "x"),
    ]
    assert run(spark, docs) == {(1, "t1"), (2, "t2"), (3, "t3"), (4, "t4"), (5, "t5"), (8, "t6"), (12, "t7"), (13, "t8")}


def test_spans_cut_the_passage_from_the_original(spark):
    t = dict(passages())["t1"].split(": ")[1]
    df = spark.createDataFrame([(1, "keep this. " + t + " and this.")], "doc_id long, text string")
    r = leakage.find_leaks(df, leakage.Passages.build(passages())).first()
    assert df.first().text[r.start : r.end] == t


def test_openings_and_empty_inputs(spark):
    p = leakage.Passages.build(passages())
    assert set(p.own) == {7}
    assert run(spark, []) == set() and run(spark, [(1, "some text", "x")], []) == set()
    assert leakage.Passages.build([("a", None), (None, "text of words"), ("b", "too short")]).ids == []


def test_blanking_keeps_offsets():
    for s in ("a\\nb", "x &amp; y", "<i>z</i> q", "gr\\u00fcn", "plain", "&eacute;t"):
        assert len(leakage.blanked(s)) == len(s)
    assert leakage.words("gr\\u00fcn &eacute;t <i>Z</i>") == ["grün", "ét", "z"]


def test_removal_cuts_exactly_and_leaves_nothing(spark):
    t = dict(passages())
    w = t["t3"].split(": ")[1].split()
    edited = " ".join(x for i, x in enumerate(w) if i % 9 != 4)
    long = " ".join(f"word{i}" for i in range(300))
    docs = [
        (1, f"{long} BEFORE {t['t1'].split(': ')[1]} AFTER {long}", "x"),
        (2, f"{long}\n{t['t2']}\n{long}\n{t['t2']}\n", "x"),
        (3, f"{long}. {edited}. {long}", "x"),
        (4, t["t4"], "x"),
        (5, long, "x"),
        (6, None, "x"),
        (7, "", "x"),
    ]
    p = leakage.Passages.build(passages())
    df = spark.createDataFrame(docs, "doc_id long, text string, task_id string")
    cleaned = leakage.remove_leaks(df, p)
    out = {r.doc_id: r for r in cleaned.collect()}
    assert out[1].text == f"{long} BEFORE  AFTER {long}" and out[1].tasks == ["t1"]
    assert out[2].text.startswith(long) and out[2].text.count(long) == 2 and w[0] not in out[2].text.split("word")[-1]
    assert out[3].text == f"{long}. . {long}" and out[3].tasks == ["t3"]
    assert out[4].text is None and out[4].removed == len(t["t4"]) and out[4].tasks == ["t4"]
    assert out[5].text == long and out[5].tasks == [] and out[5].removed == 0
    assert out[6].text is None and out[6].removed == 0 and out[7].text == ""
    assert leakage.find_leaks(cleaned, p).count() == 0
    assert leakage.remove_leaks(df, leakage.Passages.build([])).where("size(tasks) > 0").count() == 0
