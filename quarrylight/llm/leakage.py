"""Evaluation texts leaking into training text.

The evaluation passages are few and fixed, so their word n-grams go to every
worker as one small table (its size is checked). Every document's words are
windowed over against it; a document with hits is verified word by word:

* a run: consecutive words of the passage stand in the document, or
* a whole passage: all of it, apart from an opening request, stands there with
  single words replaced, added or dropped. It is aligned with the place around
  the hits, and the words found in order, weighted by how rare they are among
  the passages, must make up ``coverage`` of it.

Words are runs of letters and digits without case; escapes, entities and tags
are blanked first, keeping offsets, so found spans can be cut from the original:
:func:`remove_leaks` cuts all of them, or drops a document that is mostly leaked.
One pass over the documents, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+(?:\x00+[^\W_]*)*")
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\[nrt\"'/bf\\]")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->")

#: Parameters: words of an n-gram, hits that ask for verification, words of a
#: run, share of a whole passage, share of passages that state an opening request.
GRAM, HITS, RUN, COVERAGE, OPENING = 5, 3, 15, 0.7, 0.05
#: Words that all passages together may have, checked before they are broadcast
#: (about 30 bytes a word); every worker prepares its tables once.
MOST_WORDS = 5_000_000
#: Share of a document's words from which on it is dropped rather than cut.
MOSTLY = 0.5

_STEP = np.uint64(0x9E3779B97F4A7C15)


def blanked(text: str) -> str:
    """``text`` with escapes, entities and tags blanked or resolved, of the same length."""

    def escape(m: re.Match) -> str:
        s = m.group()
        return chr(int(s[2:], 16)).ljust(6, "\x00") if s[1] == "u" else "  "

    def entity(m: re.Match) -> str:
        c = html.unescape(m.group())
        return c.ljust(len(m.group()), "\x00") if len(c) == 1 and c.isalnum() else " " * len(m.group())

    if "\\" in text:
        text = _ESCAPE.sub(escape, text)
    if "&" in text:
        text = _ENTITY.sub(entity, text)
    if "<" in text or "-->" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    return text


def words(text: str) -> list[str]:
    """The words of a text, in lower case."""
    out = [w.lower() for w in WORD.findall(blanked(text))]
    return [w.replace("\x00", "") for w in out] if "\x00" in text or "\\u" in text or "&" in text else out


def _grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of n ids without an unknown word (0)."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    inside = np.cumsum(np.r_[0, known])
    at = np.flatnonzero(inside[n:] - inside[:-n] == n)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = (h ^ ids[at + k].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    return at, h


@dataclass
class Passages:
    """The evaluation passages, their words and the table of their n-grams."""

    ids: list[str]
    texts: list[list[str]]
    gram: int = GRAM
    own: list[int] = field(default_factory=list)  # where a passage starts after its opening request
    outer: list[list[int]] = field(default_factory=list)  # the blank-separated word of each word

    @classmethod
    def build(cls, rows: list[tuple[str, str | None]], gram: int = GRAM, opening: float = OPENING) -> Passages:
        """From (id, text); null and blank texts and passages of under ``gram`` words are left out."""
        ids, texts, outer = [], [], []
        for key, text in sorted({(k, t) for k, t in rows if k is not None and t}):
            ws, where = [], []
            for i, chunk in enumerate(blanked(text).split()):
                part = words(chunk)
                ws += part
                where += [i] * len(part)
            if len(ws) >= gram:
                ids.append(key)
                texts.append(ws)
                outer.append(where)
        if sum(map(len, texts)) > MOST_WORDS:
            raise ValueError(f"the passages have more than {MOST_WORDS} words; search them in parts")
        out = cls(ids, texts, gram, outer=outer)
        starts = Counter(tuple(t[:n]) for t in texts for n in range(1, min(40, len(t) - gram) + 1))
        least = max(3.0, opening * len(texts))
        # an opening is a start of at least four words that many passages share
        for t in texts:
            n = max((n for n in range(4, min(40, len(t) - gram) + 1) if starts[tuple(t[:n])] >= least), default=0)
            whole = starts[tuple(t[:n])] if n else 0
            # a request shared by all is not lengthened by a word that only some go on with
            while n > 4 and starts[tuple(t[: n - 1])] > 2 * whole:
                n -= 1
                whole = starts[tuple(t[:n])]
            out.own.append(n)
        return out

    def prepare(self) -> None:
        """Tables that are rebuilt on each worker rather than sent."""
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        often = Counter(w for t in self.texts for w in set(t))
        n = len(self.texts)
        self.weight = [[math.log((n + 1) / often[w]) + 0.05 for w in t] for t in self.texts]
        hashes, places = [], []
        for p, t in enumerate(self.texts):
            at, h = _grams(np.array([self.vocabulary[w] for w in t], np.int64), self.gram)
            hashes.append(h)
            places += [(p, int(i)) for i in at]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.table: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for h, place in zip(flat.tolist(), places, strict=True):
            self.table[h].append(place)
        self.keys = np.array(sorted(self.table), np.uint64)
        self.masks = []
        for t, own in zip(self.texts, self.own, strict=True):
            mask: dict[int, int] = defaultdict(int)
            for i, w in enumerate(t[own:]):
                mask[self.vocabulary[w]] |= 1 << i
            self.masks.append(dict(mask))

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """passage -> (document position, passage position) of the shared n-grams."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        at, h = _grams(ids, self.gram)
        if not len(at) or not len(self.keys):
            return out
        slot = np.searchsorted(self.keys, h)
        slot[slot == len(self.keys)] = 0
        for i in np.flatnonzero(self.keys[slot] == h):
            for p, j in self.table[int(h[i])]:
                out[p].append((int(at[i]), j))
        return out

    def longest_run(self, p: int, hits: list[tuple[int, int]]) -> tuple[int, int, int]:
        """(whole words, start, end) of the longest run; words as the passage's blanks part them."""
        pairs, best, where = set(hits), 0, self.outer[p]
        found = (0, 0, 0)
        for i, j in hits:
            if (i - 1, j - 1) in pairs:
                continue
            n = 0
            while (i + n, j + n) in pairs:
                n += 1
            first, last = j, j + n + self.gram - 2  # sub-words of the run
            whole = where[last] - where[first] + 1
            if first and where[first - 1] == where[first]:
                whole -= 1
            if last + 1 < len(where) and where[last + 1] == where[last]:
                whole -= 1
            if whole > best:
                best, found = whole, (whole, i, i + n + self.gram - 1)
        return found

    def runs(self, p: int, hits: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
        """(start, end) of all runs of at least ``least`` whole words, as :meth:`longest_run` counts them."""
        left, out = list(hits), []
        while left:
            n, a, b = self.longest_run(p, left)
            if n < least:
                break
            out.append((a, b))
            left = [(i, j) for i, j in left if i + self.gram <= a or i >= b]
        return out

    def tight(self, p: int, ids: np.ndarray, low: int, high: int) -> tuple[int, int]:
        """The least part of the words low to high that holds the same aligned words of the passage."""
        own, part = self.own[p], ids[low:high].tolist()
        text = [self.vocabulary[w] for w in self.texts[p][own:]]
        full = (1 << len(text)) - 1

        def last(part: list[int], text: list[int]) -> int:
            mask: dict[int, int] = defaultdict(int)
            for i, w in enumerate(text):
                mask[w] |= 1 << i
            v, most, at = full, 0, -1
            for k, w in enumerate(part):
                u = v & mask.get(w, 0)
                if u:
                    v = ((v + u) | (v - u)) & full
                    length = len(text) - v.bit_count()
                    if length > most:
                        most, at = length, k
            return at

        end = last(part, text)
        return high - 1 - last(part[::-1], text[::-1]) if end >= 0 else low, low + end + 1

    def cover(self, p: int, ids: np.ndarray, hits: list[tuple[int, int]]) -> tuple[float, int, int]:
        """(share, start, end): the best alignment of the whole passage around its hits."""
        own, mask = self.own[p], self.masks[p]
        m = len(self.texts[p]) - own
        weight = self.weight[p][own:]
        full, total = (1 << m) - 1, sum(weight)
        best, seen = (0.0, 0, 0), -(10**9)
        for i, j in sorted(hits):
            start = i - j + own
            if start <= seen + 8:
                continue
            seen = start
            low, high = max(0, start - 12), min(len(ids), start + m + m // 2 + 40)
            v = full  # bit-parallel longest common subsequence: a cleared bit is a passage word found in order
            for w in ids[low:high].tolist():
                u = v & mask.get(w, 0)
                if u:
                    v = ((v + u) | (v - u)) & full
            share = sum(x for k, x in enumerate(weight) if not v >> k & 1) / total
            if share > best[0]:
                best = (share, low, high)
        return best


def _places(passages: Passages, ids: np.ndarray, hits: int, run: int, coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
    """(passage, words of the longest run, share, word spans) of every passage that stands in a document's words."""
    for p, pairs in passages.hits(ids).items():
        need = min(hits, len(passages.texts[p]) - passages.own[p] - passages.gram + 1)
        if len(pairs) < need:
            continue
        n = passages.longest_run(p, pairs)[0]
        if n >= run:
            yield p, n, 0.0, passages.runs(p, pairs, run)
            continue
        share, a, b = passages.cover(p, ids, pairs)
        if share >= coverage:
            yield p, n, share, [passages.tight(p, ids, a, b)]


def _shared(documents: DataFrame, passages: Passages):
    """The passages as a broadcast, and a function that gives them prepared, once in each worker."""
    held = documents.sparkSession.sparkContext.broadcast(passages)

    def prepared() -> Passages:
        own = held.value
        if not hasattr(own, "table"):
            own.prepare()
        return own

    return prepared


def find_leaks(documents: DataFrame, passages: Passages, *, hits: int = HITS, run: int = RUN, coverage: float = COVERAGE, id_type: str = "bigint") -> DataFrame:
    """Every document that holds a passage or a run of one.

    documents: (doc_id, text); further columns are not read. A null or blank
    text has no leaks; rows that repeat give repeated results; no passages or no
    documents give none.

    Result: (doc_id, task_id, run_words, coverage, start, end), a row for each
    span; start and end are the characters of a run, or of the aligned words, in
    the original text.
    """
    schema = f"doc_id {id_type}, task_id string, run_words int, coverage double, start int, end int"
    names = ["doc_id", "task_id", "run_words", "coverage", "start", "end"]
    prepared = _shared(documents, passages)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = prepared()
        known = own.vocabulary.get
        for batch in batches:
            rows = []
            for doc_id, text in batch.itertuples(index=False):
                ids = np.array([known(w, 0) for w in words(text)], np.int64)
                offsets = None
                for p, n, share, spans in _places(own, ids, hits, run, coverage):
                    if offsets is None:
                        offsets = [m.span() for m in WORD.finditer(blanked(text))]
                    rows += [(doc_id, own.ids[p], n, share, offsets[a][0], offsets[b - 1][1]) for a, b in spans]
            yield pd.DataFrame(rows, columns=names)

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(search, schema)


def remove_leaks(documents: DataFrame, passages: Passages, *, hits: int = HITS, run: int = RUN, coverage: float = COVERAGE, mostly: float = MOSTLY, id_type: str = "bigint") -> DataFrame:
    """(doc_id, text, tasks, removed): every document without the passages that leaked into it.

    Found spans are cut and the rest is searched again, until none is left. A
    document of whose words ``mostly`` or more are cut is dropped: its text is
    null and removed is its whole length. tasks lists the passages in order,
    empty for a clean document, whose text stays as it is; removed counts
    characters. A null text stays null; repeated rows are treated alike.
    """
    prepared = _shared(documents, passages)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = prepared()
        known = own.vocabulary.get
        for batch in batches:
            rows = []
            for doc_id, text in batch.itertuples(index=False):
                tasks: set[str] = set()
                now, total, gone = text, None, 0
                while now is not None:
                    ids = np.array([known(w, 0) for w in words(now)], np.int64)
                    total = len(ids) if total is None else total
                    found = list(_places(own, ids, hits, run, coverage))
                    if not found:
                        break
                    tasks |= {own.ids[p] for p, *_ in found}
                    offsets = [m.span() for m in WORD.finditer(blanked(now))]
                    cut = np.zeros(len(ids), bool)
                    parts, at = [], 0
                    for a, b in sorted(span for *_, spans in found for span in spans):
                        cut[a:b] = True
                        low, high = offsets[a][0], offsets[b - 1][1]
                        if high > at:
                            parts.append(now[at : max(at, low)])
                            at = high
                    gone += int(cut.sum())
                    now = "".join([*parts, now[at:]])
                if tasks and gone >= mostly * total:
                    now = None
                rows.append((doc_id, now, sorted(tasks), 0 if text is None else len(text) - len(now or "")))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "tasks", "removed"])

    return documents.select("doc_id", "text").mapInPandas(clean, f"doc_id {id_type}, text string, tasks array<string>, removed int")
