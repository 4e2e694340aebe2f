"""Filling containers of fixed capacity with texts that belong together.

Texts are dealt into shards of one language and, where they name one, of related
topics. In a shard an inverted index with
BM25 weights covers every text; the longest unused text is the seed of a
container, its unused neighbours fill the window in order of score, and what
room is left takes the longest unused text that fits. Only a text longer than
the capacity is split, between tokens and where possible before a word.

A shard is one task of bounded size however many rows a language or topic has: a
bucket of topics with more rows is dealt over as many shards as it needs. The
texts are shuffled once.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.storage import broadcast_if_small, materialize

#: Where the rank file of the public tokenizer lies; a parameter, as it is not part of this package.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the pattern that splits text before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts aimed at in a shard, and shards in a bucket of topics of all languages together; the BM25 parameters.
SHARD, SPREAD, K1, B = 2_000, 4, 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")


class Tokens:
    """The byte-level tokenizer of a rank file, with what splitting needs to know of each token."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.bytes = np.zeros(size, np.int64)
        self.opens = np.zeros(size, bool)  # a blank and then a word or sign: no merge reaches across its start
        for t, i in ranks.items():
            self.bytes[i] = len(t)
            self.opens[i] = len(t) > 1 and t[:1] == b" " and not t[1:2].isspace()

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def pieces(self, text: str, tokens: list[int], capacity: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) in characters: the whole text, or pieces of at most ``capacity`` tokens.

        A piece ends before a blank that opens a word, if there is one among its
        last 16 tokens, else between characters; its tokens are those of the
        piece encoded by itself.
        """
        if len(tokens) <= capacity:
            return [(0, len(text), len(tokens))]
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        first = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])  # characters that began before a byte
        ids = np.array(tokens)
        at = np.r_[0, np.cumsum(self.bytes[ids])]
        whole = np.r_[(raw & 0xC0) != 0x80, True]
        out, i = [], 0
        while i < len(ids):
            j = min(i + capacity, len(ids))
            exact = j == len(ids)
            if not exact:
                for back in range(min(16, capacity - 1)):
                    if self.opens[ids[j - back]]:
                        j, exact = j - back, True
                        break
            while True:
                while j > i + 1 and not whole[at[j]]:
                    j -= 1
                while j < len(ids) and not whole[at[j]]:  # a character of many tokens stays whole
                    j += 1
                a, b = int(first[at[i]]), int(first[at[j]])
                count = j - i if exact and (i == 0 or self.opens[ids[i]]) else len(self.encode(text[a:b]))
                if count <= capacity or j - i <= 4:
                    break
                j, exact = j - 1, False
            if count > capacity:
                raise ValueError(f"a character has more than {capacity} tokens")
            out.append((a, b, count))
            i = j
        return out


@cache
def tokenizer(path: str) -> Tokens:
    """One tokenizer for each worker process."""
    return Tokens(path)


class _Vocabulary(dict):
    """Word -> number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Index:
    """Inverted index of a shard with BM25 weights; words in half of the texts or more weigh nothing."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        vocabulary = _Vocabulary()
        place = vocabulary.__getitem__
        words = [_WORD.findall(t.lower()) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, self.n)
        ids = np.fromiter(map(place, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        size = max(1, len(vocabulary))
        # each pair of text and word once, in the order of texts
        pair, count = np.unique(np.repeat(np.arange(self.n), lengths) * size + ids, return_counts=True)
        doc, term = pair // size, pair % size
        ends = np.searchsorted(doc, np.arange(self.n + 1))
        tf = count.astype(np.float64)
        df = np.bincount(term, minlength=len(vocabulary))
        joint = df > 1  # a word of one text leads to no other
        self.terms = [x[joint[x]] for x in (term[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
        self.known: dict[int, np.ndarray] = {}
        idf = np.maximum(0.0, np.log((self.n - df + 0.5) / (df + 0.5)))
        length = lengths.astype(np.float64)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if self.n else 1.0))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        keep = (weight > 0) & joint[term]
        term, doc, weight = term[keep], doc[keep], weight[keep]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every text for the words of text ``seed`` that other texts have; made once for all capacities."""
        if seed not in self.known:
            self.known[seed] = self._scores(seed)
        return self.known[seed]

    def _scores(self, seed: int) -> np.ndarray:
        low, high = self.start[self.terms[seed]], self.start[self.terms[seed] + 1]
        size = high - low
        total = int(size.sum())
        at = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n).astype(np.float32)


def fill(index: Index, owner: np.ndarray, size: np.ndarray, capacity: int) -> list[int]:
    """The container number of each piece; ``owner`` is the text a piece is of, ``size`` its tokens."""
    sizes = size.tolist()
    container = [-1] * len(sizes)
    free: dict[int, list[int]] = {}
    for p in np.argsort(-size, kind="stable")[::-1]:
        free.setdefault(int(size[p]), []).append(int(p))
    lengths = 0  # bit l is set while a free piece of l tokens is left
    for l in free:  # noqa: E741
        lengths |= 1 << l
    by_text: dict[int, list[int]] = {}
    for p in range(len(size)):
        by_text.setdefault(int(owner[p]), []).append(p)
    number = 0

    def take(p: int) -> int:
        nonlocal lengths
        l = sizes[p]  # noqa: E741
        container[p] = number
        left = free[l]
        if left[-1] == p:
            left.pop()
        else:
            left.remove(p)
        if not left:
            lengths &= ~(1 << l)
        return l

    smallest = int(size.min()) if len(size) else 0
    least = np.full(index.n, capacity + 1)  # the smallest piece of each text
    np.minimum.at(least, owner, size)
    rest = np.bincount(owner, minlength=index.n) if len(size) else np.zeros(index.n)
    while lengths:
        seed = free[lengths.bit_length() - 1][-1]
        room = capacity - take(seed)
        rest[owner[seed]] -= 1
        if room >= smallest and lengths & ((1 << (room + 1)) - 1):
            score = index.scores(int(owner[seed]))
            near = np.flatnonzero((score > 0) & (rest > 0) & (least <= room))
            for t in near[np.argsort(-score[near], kind="stable")].tolist():
                if room < smallest:
                    break
                for p in by_text[t]:
                    if sizes[p] <= room and container[p] < 0:
                        room -= take(p)
                        rest[t] -= 1
            while room > 0:
                fitting = lengths & ((1 << (room + 1)) - 1)
                if not fitting:
                    break
                p = free[fitting.bit_length() - 1][-1]
                room -= take(p)
                rest[owner[p]] -= 1
        number += 1
    return container


PACKED = "model_name string, container string, doc_id {id}, piece_no int, start int, end int, tokens int"


def pack(documents: DataFrame, capacities: dict[str, int], rows: int, ranks: str = RANKS, id_type: str = "bigint") -> DataFrame:
    """The container of each text or piece, for each capacity.

    documents: (doc_id, text, lang) and, if there, topic, by which related texts
    come into one shard; rows: their number, which sets the buckets; capacities:
    tokens of a container by model name; ranks: the tokenizer's rank file, which
    is sent to the executors.

    Result: (model_name, container, doc_id, piece_no from 0, start, end, tokens);
    start and end count characters. Null and empty texts need no container;
    repeated rows are packed as often as they stand there; an unknown or null
    language is one of its own. No documents or no capacities give no rows.
    """
    buckets = max(1, rows // (SPREAD * SHARD))
    topic = F.col("topic") if "topic" in documents.columns else F.lit(None)
    dealt = documents.where("text is not null and text <> ''").select(
        "doc_id", "text", F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), F.pmod(F.xxhash64(topic), F.lit(buckets)).cast("int").alias("bucket")
    )
    sizes = dealt.groupBy("lang", "bucket").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    sizes = broadcast_if_small(materialize(sizes, "buckets"))
    dealt = dealt.join(sizes, ["lang", "bucket"]).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.col("shards"))).drop("shards")
    documents.sparkSession.sparkContext.addFile(ranks)
    ranks = os.path.basename(ranks)
    schema = PACKED.format(id=id_type)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, part):
        coder = tokenizer(SparkFiles.get(ranks))
        part = part.sort_values(["doc_id", "text"], kind="stable")
        texts, ids = part["text"].tolist(), part["doc_id"].values
        index = Index(texts)
        encoded = [coder.encode(t) for t in texts]
        out = []
        mark = f"{key[0]}-{key[1]}-{key[2]}-"
        for model, capacity in capacities.items():
            cut = [coder.pieces(t, tokens, capacity) for t, tokens in zip(texts, encoded, strict=True)]
            many = np.fromiter(map(len, cut), np.int64, len(cut))
            owner = np.repeat(np.arange(len(cut)), many)
            start, end, size = (np.array(x, np.int64) for x in zip(*chain.from_iterable(cut), strict=True))
            number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            where = fill(index, owner, size, capacity)
            out.append(pd.DataFrame({"model_name": model, "container": [mark + str(c) for c in where], "doc_id": ids[owner], "piece_no": number, "start": start, "end": end, "tokens": size}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    return dealt.groupBy("lang", "bucket", "shard").applyInPandas(run, schema)
