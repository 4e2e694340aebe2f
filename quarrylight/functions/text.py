"""Scalar functions over text, identifiers and hashes, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes in hex."""
    return F.sha2(text, 256)


def ordered_hash(path: Column, digest: Column) -> Column:
    """F01, an aggregate: SHA-256 over path and hash of all rows of a group, in path order.

    Meant for a manifest of moderate size; the group's (path, hash) pairs are sorted in one buffer.
    """
    pairs = F.array_sort(F.collect_list(F.struct(path.alias("p"), digest.alias("h"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda s: F.concat(s["p"], s["h"])), ""), 256)


#: fixed values: the characters that Python's ``str.strip`` takes for white space, as a class of Java's patterns
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def cache_key(model: Column, version: Column, text: Column, backend: str = "onnx", quantization: str = "int8") -> Column:
    """the key of an embedding in its cache; the outer white space is Unicode's, as in Python's ``strip``."""
    stripped = F.regexp_replace(text, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")
    return F.sha2(F.concat_ws(":", model, version, F.lit(backend), F.lit(quantization), stripped), 256)


def normalised_query(text: Column) -> Column:
    """no back-ticks, single blanks, no closing ?!., and lower case."""
    one = F.regexp_replace(F.translate(text, "`", ""), r"\s+", " ")
    return F.lower(F.trim(F.regexp_replace(F.trim(one), r"[?!.,]+$", "")))


def camel_match(name: Column, query: Column) -> Column:
    """whether the capitals of a name contain the query in capitals."""
    return F.contains(F.regexp_replace(name, r"[^\p{Lu}]", ""), F.upper(query))


def declared_all(text: Column) -> Column:
    """the names listed in a Python ``__all__``, null where there is no list."""
    inside = F.regexp_extract(text, r"__all__\s*=\s*[\[(]([^\])]*)[\])]", 1)
    return F.when(text.rlike(r"__all__\s*=\s*[\[(]"), F.array_distinct(F.regexp_extract_all(inside, F.lit(r"['\"](\w+)['\"]"), 1)))


#: fixed values: secrets by form
SECRETS = r"(?i)(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}|(?<=(?:password|passwd|secret|token|api_key|apikey)[=:]\s?)[^\s\"',;]{6,}"


def redacted(text: Column, mark: str = "[REDACTED]") -> Column:
    """keys, tokens and assigned secrets replaced by a mark."""
    return F.regexp_replace(text, SECRETS, mark)


def redacted_literals(text: Column, secrets: list[str], mark: str = "***") -> Column:
    """known secrets replaced wherever they stand, longest first; empty ones are passed over."""
    out = text
    for s in sorted(filter(None, secrets), key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(s), F.lit(mark))
    return out


def hours_label(hours: Column) -> Column:
    """an effort in words."""
    return F.when(hours.isNull(), F.lit(None)).when(hours < 2, "under 2 hours").when(hours < 8, "half a day").when(hours < 24, "1-3 days").when(hours < 80, "1-2 weeks").otherwise("over 2 weeks")


def repository_name(url: Column) -> Column:
    """owner/name in lower case from a URL, without scheme, host, .git and closing slash."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:[a-z+]+://)?(?:[^@/]+@)?[^/:]+[/:]", ""), r"(?:\.git)?/*$", "")
    return F.lower(rest)


def ref_name(ref: Column) -> Column:
    """a branch or tag without its refs prefix."""
    return F.regexp_replace(F.trim(ref), r"^refs/(?:heads|tags|remotes/[^/]+)/", "")


def span_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """F16: whether the first span holds the second."""
    return (a_start <= b_start) & (b_end <= a_end)


def span_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """F16: whether two half-open spans share a place."""
    return (a_start < b_end) & (b_start < a_end)


#: fixed values: words that tell nothing of a question
STOP_WORDS = "a an and are as at be by can do does for from how in is it of on or that the this to what where which with".split()


def token_set(text: Column) -> Column:
    """Different identifiers of more than one letter in lower case, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]*"), 0))
    return F.filter(F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS])), lambda w: F.length(w) > 1)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that stand in the text; 0 without tokens."""
    q = token_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, token_set(text))) / F.size(q)).otherwise(F.lit(0.0))
