"""Splitting oversized items at natural boundaries, with overlap.

Separators form a hierarchy: section, paragraph, sentence or line, word, single
character. An item over the limit is parted at its highest separators, each part
that is still too long at the next ones, and so on; then neighbouring parts are
packed greedily into pieces up to the limit. Each further piece begins with the
last ``overlap`` characters of the one before, so its new part is that much
shorter.

A character is looked at once for each level at most, so the work is linear in
an item's length. Items are independent, so the plan has no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: A section starts after blank lines at a line without indent that opens a
#: definition or a heading; a paragraph after blank lines; a sentence after its
#: mark and white space or after a line feed; a word after white space or
#: before and after punctuation.
LEVELS = (
    re.compile(r"\n[ \t]*\r?\n(?=(?:#{1,6} |@|[A-Za-z_$/*]))"),
    re.compile(r"\n[ \t]*\r?\n+"),
    re.compile(r"\n|[.!?][)\]\"'”’]*[ \t]+|[。！？]"),
    re.compile(r"\s+|[,;:(){}\[\]=+|&<>]"),
)


@dataclass(frozen=True)
class SplitRule:
    """Limits of one kind of item: the model's name and version, and sizes in characters."""

    model_name: str
    model_version: str
    max_chars: int
    overlap_chars: int

    def __post_init__(self) -> None:
        if self.max_chars < 1 or not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError(f"an overlap of {self.overlap_chars} does not fit pieces of {self.max_chars} characters")

    def chunk_hash(self, piece: str) -> str:
        text = f"{self.model_name}:{self.model_version}:onnx:int8:{piece.strip()}"
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _parts(text: str, start: int, end: int, level: int, most: int) -> Iterator[tuple[int, int]]:
    """(end, level) of the parts of a stretch, none longer than ``most``; the level of the separator that ends it."""
    if end - start <= most:
        yield end, level
        return
    if level == len(LEVELS):
        at = start
        while end - at > most:
            cut = at + most
            # a character that combines with the one before is not parted from it, nor a line feed from its carriage return
            while cut > at + 1 and (unicodedata.combining(text[cut]) or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            at = cut if cut > at + 1 or most == 1 else at + most
            yield at, level
        yield end, level
        return
    at = start
    for m in LEVELS[level].finditer(text, start, end):
        if at < m.end() < end:
            yield from _ended(_parts(text, at, m.end(), level + 1, most), level)
            at = m.end()
    yield from _parts(text, at, end, level + 1, most)


def _ended(parts: Iterator[tuple[int, int]], level: int) -> Iterator[tuple[int, int]]:
    """The parts, the last of them ending at a separator of ``level``."""
    before = None
    for part in parts:
        if before:
            yield before
        before = part
    yield before[0], level


def cut_points(text: str, max_chars: int, overlap: int) -> list[int]:
    """Where the pieces end. One point, the length, for an item within the limit.

    Piece i is ``text[cut[i - 1] - overlap : cut[i]]``. Parts are packed while
    they fit. A full piece ends at the highest separator in the later half of
    its new part, what follows it goes to the next piece; the first piece is
    longer than ``overlap``, so that it has as much to repeat.
    """
    size = len(text)
    if size <= max_chars:
        return [size]
    room = max_chars - overlap  # of the new part of a further piece
    cuts: list[int] = []
    done, ends = 0, []  # of the piece being packed: its start, the ends of its parts

    def limit() -> int:
        return done + (room if cuts else max_chars)

    for end, level in _parts(text, 0, size, 0, room):
        while end > limit():
            middle = done + (limit() - done) // 2 if cuts else max(max_chars // 2, overlap)
            late = [e for e in ends if e[0] > middle] or [e for e in ends if cuts or e[0] > overlap]
            if late:
                at = min(late, key=lambda e: (e[1], -e[0]))[0]
            else:
                at = limit()  # the first piece has no end beyond the overlap
            cuts.append(at)
            done, ends = at, [e for e in ends if e[0] > at]
        ends.append((end, level))
    cuts.append(size)
    return cuts


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; a blank or empty text is one piece."""
    cuts = cut_points(text, max_chars, overlap)
    return [(max(0, (cuts[i - 1] if i else 0) - (overlap if i else 0)), end) for i, end in enumerate(cuts)]


PIECES = "model_name string, repository_id string, content_hash string, piece_no int, pieces int, start int, end int, chunk_hash string"


def split_items(bodies: DataFrame, rules: list[SplitRule], *, oversized_only: bool = True, with_text: bool = False) -> DataFrame:
    """Pieces of every body for every rule.

    bodies: (repository_id, content_hash, content); further columns are not read.
    oversized_only: leave out bodies within a rule's limit (else they are one piece).
    with_text: add the piece itself as ``piece``.

    Result: (model_name, repository_id, content_hash, piece_no from 0, pieces,
    start, end, chunk_hash[, piece]); start and end count characters. A null body
    has no pieces, an empty one is a single empty piece; repeated rows give
    repeated pieces; no rules or no rows give none.
    """
    schema = PIECES + (", piece string" if with_text else "")
    small = bodies.select("repository_id", "content_hash", "content").where("content is not null")
    if oversized_only and rules:
        small = small.where(f"char_length(content) > {min(r.max_chars for r in rules)}")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for repository, content_hash, text in batch.itertuples(index=False):
                for r in rules:
                    if oversized_only and len(text) <= r.max_chars:
                        continue
                    spans = split_text(text, r.max_chars, r.overlap_chars)
                    for i, (a, b) in enumerate(spans):
                        piece = text[a:b]
                        row = (r.model_name, repository, content_hash, i, len(spans), a, b, r.chunk_hash(piece))
                        out.append((*row, piece) if with_text else row)
                        if len(out) >= 20_000:
                            yield pd.DataFrame(out, columns=_names(schema))
                            out = []
            yield pd.DataFrame(out, columns=_names(schema))

    return small.mapInPandas(pieces, schema)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
