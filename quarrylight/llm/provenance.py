"""Generated, minified, vendored and data files among source files.

Names tell who wrote a file. For each language a character trigram model of
identifiers is trained on all bodies; then, for each body,

* names whose cross-entropy under the model is high are mangled: minified;
* definitions whose names repeat each other's characters are made from a
  template: generated;
* names joined in another style than the repository's own (underscores against
  inner capitals) are foreign; that sign is reported but decides nothing, as code
  under a wrong extension shows it and copies in the repository's own style do not.
  Copies are told by their wording instead: 0.8 or more of a body's runs of five
  words stand in copies in other repositories. Packages that foreign files name
  in their leading comments are learned, and a vendor folder of such a package is
  foreign as well: vendored;
* bodies that are mostly literals are data saved as code.

Banners and folder names alone decide nothing: writers of generators have them
in their own code. The sketch of a body only proposes it as a copy; whether it
is one is decided on all its runs. What is shuffled are trigram counts (bounded
by the alphabet), sixteen keys for each body, and all runs of the proposed bodies.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters: excess of the cross-entropy of a body's bound names over its
#: language's (bits a character) that means mangled, for short names and for any;
#: share of different 4-grams among defined names, and of names with one start,
#: that mean templates, from so many definitions; share of literals that means
#: data; fewest names whose cross-entropy is judged.
MANGLED, MANGLED_LONG, DIVERSITY, ALIKE, DEFINED, LITERALS, NAMES = 3.0, 4.0, 0.78, 0.43, 5, 0.75, 8
#: Parameters of wording: words of a run; words under which a body counts as one
#: run; bands of a sketch and least hashes in each (two bodies that share 0.8 of
#: their runs have no band in common with a chance of 2 in 10,000, two that share
#: 0.1 have one with a chance of 2 in 1,000); share of all runs that makes a copy.
SHINGLE, SHORT, BANDS, BAND, FOREIGN = 5, 12, 16, 4, 0.8
#: Parameters of style: names of two parts or more that a body, and the rest of its
#: repository in that language, must have, and how far their shares must lie apart.
STYLED, STYLED_REST, STYLE = 8, 200, 0.8

_WORD = re.compile(r"\w+")
_BOUND = re.compile(r"(?<![\w$.'\"`#@/\\])[A-Za-z_$][\w$]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?<![:\"'])//[^\n]*|(?m:^[ \t]*#[^\n]*)|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")
_LITERAL_RUN = re.compile(r"(?:(?:[-+]?(?:0[xX][0-9A-Fa-f]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[lLfFuU]?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b(?:true|false|null|nil|None|True|False)\b)[\s,:;\]\[(){}]+){8,}")
_LEADING = re.compile(r"(?:\s|\ufeff|#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|--[^\n]*|;[^\n]*)*")
_CAMEL, _SNAKE = re.compile(r"[a-z0-9][A-Z]"), re.compile(r"[A-Za-z0-9]_[A-Za-z0-9]")
#: fixed values: words that a definition's line begins with
_DEFINERS = frozenset("def class function function* interface enum record struct trait fn func public private protected static final abstract export async const let var synchronized declare default".split())
#: such lines of a text that begins with a line feed; a definition is behind blanks and tabs only
_DEFINER_LINE = re.compile(r"\n([ \t]*(?:" + "|".join(map(re.escape, sorted(_DEFINERS, reverse=True))) + r")(?![^ \n])[^\n]*)")
_DEFINED = re.compile(
    r"[ \t]*(?:(?:export|default|declare|async|public|private|protected|static|final|abstract|synchronized)[ \t]+)*"
    r"(?:(?:def|class|function\*?|interface|enum|record|struct|trait|fn)[ \t]+([A-Za-z_$][\w$]*)|func[ \t]+(?:\([^)\n]*\)[ \t]*)?([A-Za-z_]\w*)"
    r"|(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[ \t]*[=:;]|[\w$<>\[\], ]*?[ \t]*\b([A-Za-z_$][\w$]*)[ \t]*[(=;])"
)
#: fixed values: words of the languages, which are no names
KEYWORDS = frozenset(
    "if else for while return def class async await import from try except finally raise with as in is not and or lambda yield pass break continue None True False global nonlocal del "
    "assert const let var function export default new this null undefined typeof instanceof extends implements interface type enum public private protected static final void int long "
    "double float boolean char byte short throw throws catch package func struct map chan go defer range switch case select string error nil self super record number unknown any true false "
    "abstract readonly namespace declare do of get set constructor".split()
)
#: fixed values: what a header says of a package that is copied; the package's name is a group
_UPSTREAM = re.compile(
    r"(?i)(?:copied (?:verbatim )?from|vendored from|part of|taken from|bundled from|imported from) @?([a-z][\w.-]*?)[ ,]+(?:v|version |release |rev(?:ision)? )?\d|\(c\) the ([a-z][\w.-]*) (?:contributors|authors|developers|project)"
    r"|^\W*@?([a-z][\w.-]*) v?\d+(?:\.\d+)+ - https?://|upstream: https?://(?:git\.|www\.)?([a-z][\w-]*)\.|^\W*/?\*?!? ?@?([a-z][\w.-]*) v\d+(?:\.\d+)+ ?(?:\||$)",
    re.M,
)
#: fixed values: a header without any of these cannot match the pattern
_UPSTREAM_WORDS = ("copied", "vendored", "part of", "taken from", "bundled from", "imported from", "(c) the", "upstream", " - http", " v0", " v1", " v2", " v3", " v4", " v5", " v6", " v7", " v8", " v9")
#: fixed values: folders that hold packages of others
VENDOR_FOLDERS = "vendor|vendors|third_party|third-party|thirdparty|3rdparty|3rd-party|node_modules|bower_components|external|externals|extern|deps|bundled|site-packages|Godeps|Pods|contrib"


def without_comments(text: str) -> str:
    return _COMMENT.sub(" ", text)


def bare(plain: str) -> str:
    """A body without comments, without the insides of its strings."""
    return _STRING.sub("\"\"", plain)


def bound_names(code: str) -> set[str]:
    """Identifiers of bare code that do not follow a dot: members keep their names when others are mangled."""
    return set(_BOUND.findall(code)) - KEYWORDS


class _Folds(dict):
    """Code point -> the sign that stands for it in trigrams, made on first sight."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "0" if c.isdecimal() else c if c in "abcdefghijklmnopqrstuvwxyz_$" else "?"
        return out


_folds = _Folds()


def _grams(name: str) -> list[str]:
    """Trigrams of a name between edge marks; letters without case, digits and other signs folded."""
    s = f"^{name.lower().translate(_folds)}|"
    return [s[:2], *map("".join, zip(s, s[1:], s[2:]))]


def train(judged: DataFrame) -> dict[str, dict[str, int]]:
    """Trigram counts of bound names by language, over all bodies.

    judged: (language, names) with the different names of a body joined by blanks.
    Each body counts each of its names once. Bodies with a mean name length under
    3 are left out, as a language's usual names are to be learned. The table is
    bounded by the folded alphabet of 40 signs.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, Counter] = {}
        for batch in batches:
            for language, joined in batch.itertuples(index=False):
                own = joined.split()
                if own and len(joined) + 1 >= 4 * len(own):
                    names.setdefault(language, Counter()).update(own)
        rows = []
        for language, counted in names.items():
            grams: Counter = Counter()
            for name, n in counted.items():
                for g in _grams(name):
                    grams[g] += n
            rows += [(language, g, n) for g, n in grams.items()]
        yield pd.DataFrame(rows, columns=["language", "gram", "n"])

    out: dict[str, dict[str, int]] = {}
    counted = judged.where("names is not null").select("language", "names").mapInPandas(count, "language string, gram string, n long")
    for r in counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["language"], {})[r["gram"]] = r["n"]
    return out


class Model:
    """Cross-entropy of names under the trigram counts of a language."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.context: Counter = Counter()
        for g, n in counts.items():
            self.context[g[:-1]] += n
        self.cache: dict[str, float] = {}
        self.known: dict[str, float] = {}
        bits = sum(n * self._bits(g) for g, n in counts.items())
        self.usual = bits / max(1, sum(counts.values()))

    def _bits(self, gram: str) -> float:
        return -math.log2((self.counts.get(gram, 0) + 0.2) / (self.context[gram[:-1]] + 8.0))

    def _known_bits(self, gram: str) -> float:
        v = self.known.get(gram)
        if v is None:
            v = self.known[gram] = self._bits(gram)  # bounded by the folded alphabet
        return v

    def excess(self, names: list[str]) -> float:
        """Bits a character above the language's usual, averaged over names."""
        total = 0.0
        for n in names:
            v = self.cache.get(n)
            if v is None:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                g = _grams(n)
                v = self.cache[n] = sum(map(self._known_bits, g)) / len(g)
            total += v
        return total / len(names) - self.usual if names else 0.0


def templated(text: str) -> bool:
    """Whether the defined names have the low diversity of a template's output."""
    names = []
    for line in _DEFINER_LINE.findall("\n" + text):
        if m := _DEFINED.match(line):
            names.append(re.sub(r"\d+", "0", m.group(m.lastindex).lower()))
    if len(names) < DEFINED:
        return False
    most = Counter(n[:7] for n in names).most_common(1)[0][1]
    if most < DEFINED - 1 or most < ALIKE * len(names):
        return False
    grams = [g for n in names for g in ([n[i : i + 4] for i in range(len(n) - 3)] or [n])]
    return len(set(grams)) <= DIVERSITY * len(grams)


def literal_share(text: str, code: str) -> float:
    """Share of a body that is runs of literals or long strings without blanks; ``code`` is its bare code."""
    if 8 * sum(map(code.count, "0123456789")) < len(code) and 4 * text.count('"') + 4 * text.count("'") < len(code) and max(map(len, text.split()), default=0) < 48:
        return 0.0  # too few digits and quotes, and no string that is solid enough
    solid = len(text) - text.count(" ") - text.count("\n")
    dense = 0

    def count(m: re.Match) -> str:
        nonlocal dense
        s = m.group()
        dense += len(s) - s.count(" ") - s.count("\n")
        return " "

    rest = _LITERAL_RUN.sub(count, text)
    for m in _STRING.finditer(rest):
        s = m.group()
        if len(s) >= 50 and s.count(" ") * 40 < len(s):
            dense += len(s)
    return min(1.0, dense / max(1, solid))


class _Places(dict):
    """Word -> its place in a table of 64-bit hashes, made on first sight."""

    def __init__(self) -> None:
        self.table = array("Q")

    def __missing__(self, word: str) -> int:
        self.table.append(int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
        self[word] = len(self.table) - 1
        return len(self.table) - 1


_places = _Places()


def shingles(text: str, plain: str) -> np.ndarray:
    """Different hashes of the runs of five words of a body without comments.

    A body of under twelve such words says too little by its runs; it counts as
    one run of all its words, comments included. A body without words has none.
    """
    words = _WORD.findall(plain)
    width = SHINGLE
    if len(words) < SHORT:
        words = _WORD.findall(text)
        width = len(words)
        if not words:
            return np.zeros(0, np.uint64)
    if len(_places) > 300_000:
        _places.clear()
        _places.table = array("Q")
    at = np.fromiter(map(_places.__getitem__, words), np.int64, len(words))
    h = np.frombuffer(_places.table, np.uint64)[at]  # a copy: the table may grow again
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : len(h) - width + 1 + k]
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


_TURNS = np.random.default_rng(5).integers(0, 2**63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str, plain: str) -> list[int]:
    """Keys of the bands of least hashes of :func:`shingles`; near copies have one in common, others seldom."""
    h = shingles(text, plain)
    if not len(h):
        return []
    turned = h[None, :] * _TURNS[:, None]
    least = (turned ^ (turned >> np.uint64(31))).min(1).reshape(BANDS, BAND)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def upstream(text: str) -> str | None:
    """The package that a leading comment names as the origin of the file."""
    head = _LEADING.match(text).group()
    low = head.lower()
    m = _UPSTREAM.search(head) if any(w in low for w in _UPSTREAM_WORDS) else None
    return next(filter(None, m.groups())).lower().rstrip(".,") if m else None


class _Styles(dict):
    """Name -> (inner capitals, underscores) as 0 or 1, found on first sight; none for a name in capitals."""

    def __missing__(self, name: str) -> tuple[int, int]:
        self[name] = out = (0, 0) if name.isupper() else (int(bool(_CAMEL.search(name))), int(bool(_SNAKE.search(name))))
        return out


_styles = _Styles()


def style(names: set[str]) -> tuple[int, int]:
    """(names with inner capitals, names with underscores) among names in small or mixed letters."""
    if len(_styles) > 300_000:
        _styles.clear()
    own = [_styles[n] for n in names]
    return sum(c for c, _ in own), sum(u for _, u in own)


#: fixed values: languages whose files are no code
NO_CODE = ("json", "markdown", "text", "yaml", "xml", "csv", "unknown")
FEATURES = "repository_id string, content_hash string, language string, templated boolean, data boolean, package string, sketch array<long>, names string, camel int, snake int"


def features(bodies: DataFrame) -> DataFrame:
    """What each body's names and literals say; see :data:`FEATURES`.

    bodies: (repository_id, content_hash, language, content); null bodies are
    left out. ``names`` holds the different bound names, joined by blanks.
    """
    columns = [c.split()[0] for c in FEATURES.split(", ")]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repository, content_hash, language, text in batch.itertuples(index=False):
                plain = without_comments(text)
                if language in NO_CODE:
                    rows.append((repository, content_hash, language, False, False, upstream(text), sketch(text, plain), None, 0, 0))
                    continue
                code = bare(plain)
                names = bound_names(code)
                rows.append((repository, content_hash, language, templated(code), literal_share(text, code) >= LITERALS, upstream(text), sketch(text, plain), " ".join(sorted(names)), *style(names)))
            yield pd.DataFrame(rows, columns=columns)

    return bodies.where("content is not null").select("repository_id", "content_hash", "language", "content").mapInPandas(look, FEATURES)


def copied(bodies: DataFrame, judged: DataFrame, materialize, broadcast_if_small) -> DataFrame:
    """(repository_id, content_hash): bodies of which 0.8 or more of all runs of words stand in copies in other repositories.

    A sketch proposes: one of its bands must stand in another repository. Then
    all runs of the proposed bodies are compared.
    """
    key = ["repository_id", "content_hash"]

    def elsewhere(marks: DataFrame) -> DataFrame:
        ends = marks.groupBy("h").agg(F.min("r").alias("low"), F.max("r").alias("high"))
        return marks.join(broadcast_if_small(materialize(ends.where("low <> high").select("h"), "shared")), "h", "left_semi")

    marks = judged.select("id", F.xxhash64("repository_id").alias("r"), F.explode("sketch").alias("h"))
    proposed = judged.select("id", *key).join(elsewhere(marks).select("id").distinct(), "id", "left_semi").select(*key).distinct()

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = [shingles(t, without_comments(t)).view(np.int64) for t in batch["content"]]
            yield pd.DataFrame({"repository_id": batch["repository_id"], "content_hash": batch["content_hash"], "runs": h})

    proposed = materialize(proposed, "proposed")
    texts = bodies.where("content is not null").select(*key, "content").join(broadcast_if_small(proposed), key, "left_semi").dropDuplicates(key)
    every = texts.mapInPandas(runs, "repository_id string, content_hash string, runs array<long>").withColumn("id", F.monotonically_increasing_id())
    every = materialize(every, "runs")
    known = elsewhere(every.select("id", F.xxhash64("repository_id").alias("r"), F.explode("runs").alias("h")))
    known = known.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return every.select("id", *key, F.size("runs").alias("size")).join(known, "id").where(F.col("n") >= FOREIGN * F.col("size")).select(*key)


def foreign_style(judged: DataFrame) -> DataFrame:
    """(id): bodies whose names are joined in another style than those of the rest of their repository in their language."""
    own = F.col("camel") + F.col("snake")
    whole = judged.groupBy("repository_id", "language").agg(F.sum("camel").alias("c"), F.sum("snake").alias("s"))
    rest = F.col("c") + F.col("s") - own
    apart = F.abs(F.col("camel") / own - (F.col("c") - F.col("camel")) / rest) >= STYLE
    return judged.where(own >= STYLED).join(whole, ["repository_id", "language"]).where((rest >= STYLED_REST) & apart).select("id")


def mangled(judged: DataFrame, counts: dict[str, dict[str, int]]) -> DataFrame:
    """The ids of (id, language, names) whose names have too high a cross-entropy."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {k: Model(v) for k, v in counts.items()}
        for batch in batches:
            bad = []
            for i, language, joined in batch.itertuples(index=False):
                names = joined.split()
                if language in models and len(names) >= NAMES:
                    short = len(joined) + 1 <= 4 * len(names)
                    if models[language].excess(names) > (MANGLED if short else MANGLED_LONG):
                        bad.append(i)
            yield pd.DataFrame({"id": pd.Series(bad, dtype="int64")})

    return judged.where("names is not null").select("id", "language", "names").mapInPandas(score, "id long")


def not_by_hand(units: DataFrame, bodies: DataFrame, materialize, broadcast_if_small) -> DataFrame:
    """File units whose body was not written by hand in their repository.

    units: (repository_id, commit_sha, path, language, content_hash), one row for each unit;
    bodies: (repository_id, content_hash, content). The two functions write a
    table to shared storage and hint a broadcast for a written table of checked size.

    Result: (repository_id, commit_sha, path, minified, generated, data, vendored),
    of vendored which sign was seen: copied (wording), named (a leading comment)
    and placed (a folder or file name of a package that some leading comment
    names), and styled (names in a foreign style, which decides nothing). Which of two repositories wrote a
    shared text first is not known: both are vendored. Units without a fetched
    body, and null ids, are never a case; a body used under several languages is
    judged under each. Files in :data:`NO_CODE` can be vendored only. Empty
    tables give no rows.
    """
    key = ["repository_id", "content_hash"]
    units = units.withColumn("language", F.coalesce("language", F.lit("unknown")))
    joined = bodies.where("content is not null").select(*key, "content").join(units.select(*key, "language").distinct(), key)
    judged = materialize(features(joined).withColumn("id", F.monotonically_increasing_id()), "judged")
    bad = mangled(judged, train(judged)).withColumn("mangled", F.lit(True))
    styled = foreign_style(judged).withColumn("styled", F.lit(True))
    same = copied(bodies, judged, materialize, broadcast_if_small).withColumn("copied", F.lit(True))
    flags = ["mangled", "styled", "copied"]
    known = judged.join(bad, "id", "left").join(styled, "id", "left").join(same, key, "left").na.fill(False, flags)
    known = materialize(known.select(*key, "language", *flags, "templated", "data", "package"), "known")

    packages = broadcast_if_small(materialize(known.where("package is not null").select("package").distinct(), "packages"))
    folder = F.lower(F.regexp_extract("path", rf"(?i)(?:^|/)(?:{VENDOR_FOLDERS})/(?:[^/]+/)*?(?=[^/]+/[^/]*$)([^/]+)/", 1))
    stem = F.lower(F.regexp_extract("path", r"(?:^|/)([A-Za-z][A-Za-z-]*?)[\d_.-]*\.[A-Za-z.]+$", 1))
    placed = units.select(*key, "commit_sha", "path", F.explode(F.array_distinct(F.array(folder, stem))).alias("package"))
    placed = placed.join(packages, "package", "left_semi").select("repository_id", "commit_sha", "path").distinct().withColumn("placed", F.lit(True))

    out = units.join(known, [*key, "language"]).join(placed, ["repository_id", "commit_sha", "path"], "left").na.fill(False, ["placed"])
    out = out.withColumn("named", F.col("package").isNotNull())
    vendored = F.col("copied") | F.col("named") | F.col("placed")
    out = out.select("repository_id", "commit_sha", "path", F.col("mangled").alias("minified"), F.col("templated").alias("generated"), "data", vendored.alias("vendored"), "copied", "named", "placed", "styled")
    return out.where("minified or generated or data or vendored")
