"""p5_found: the quick ways to trigrams, styles and definitions give what the plain ones give, and trigrams are looked up once."""

from __future__ import annotations

import re

from quarrylight.llm import provenance as p

NAMES = ["a", "_", "fooBar2", "snake_case_9", "MAX_SIZE", "$el", "naïveÉté", "x٣y²", "İstanbul", "é", "日本_語3", "camelCase_and_snake"]


def test_trigrams_are_folded_as_before():
    for name in NAMES:
        s = f"^{re.sub(r'[^a-z_$0]', '?', re.sub(r'\d', '0', name.lower()))}|"
        assert p._grams(name) == [s[max(0, i - 2) : i + 1] for i in range(1, len(s))]


def test_each_trigram_is_judged_once(monkeypatch):
    model = p.Model({"^a": 3, "^ab": 2, "abc": 5, "bc|": 1})
    calls = []
    was = model._bits
    monkeypatch.setattr(model, "_bits", lambda g: calls.append(g) or was(g))
    got = model.excess(["abc", "abcabc", "abcabcabc"])
    assert len(calls) == len(set(calls))
    plain = sum(sum(map(was, p._grams(n))) / len(p._grams(n)) for n in ["abc", "abcabc", "abcabcabc"]) / 3 - model.usual
    assert abs(got - plain) < 1e-12


def test_styles_of_names():
    mixed = [n for n in NAMES if not n.isupper()]
    for _ in range(2):
        assert p.style(set(NAMES)) == (sum(bool(p._CAMEL.search(n)) for n in mixed), sum(bool(p._SNAKE.search(n)) for n in mixed))


def test_lines_of_definitions():
    texts = ["def a(): pass\n\n  def b(x):\n\tclass C:\nfunction* gen() {}\r\nfunction*x() {}", "\r def odd():\n\x0c def page():\n\xa0class N:\nasync\ndefine f()\nlet\tx = 1", "", "\n", "const x = 1; let y = 2\nexport default class Q {"]
    for text in texts:
        plain = [x for x in text.split("\n") if x.lstrip().split(" ", 1)[0] in p._DEFINERS and p._DEFINED.match(x)]
        assert [x for x in p._DEFINER_LINE.findall("\n" + text) if p._DEFINED.match(x)] == plain
