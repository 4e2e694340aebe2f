"""Personal information inside free text: found, and replaced by keyed surrogates.

Detection is one pass over each whole text: emails (plain and disguised),
phones, identity numbers and street addresses by their formats and the words
before them, person names by a small model fitted to labelled names (author and
committer names) against ordinary words.

Replacement is keyed and consistent with the type: letters and digits of an
entity are permuted by a keyed Feistel network that keeps length, case and
separators, so equal entities stay equal wherever they stand, different ones of
one shape stay different, and formats stay valid. Words of names and streets
are permuted likewise and then spelled in syllables of their own script, one to
one, so different names stay different in the whole corpus; an initial becomes
the first letter of whatever replaces the names that begin with it, and given
names end by gender (title or ending). Every surrogate stands in a placeholder
that names its type.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled names and ordinary words that the trigram score is fitted to, at most,
#: and words of names that workers hold as a list; more are joined to the documents.
MOST_NAMES, MOST_WORDS, MOST_HELD = 50_000, 50_000, 500_000

class Taken:
    """Spans without overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int]] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return not k or self.spans[k - 1][1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.spans.insert(k, (a, b))


# ---------------------------------------------------------------- emails

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]{0,62}[A-Za-z0-9_+])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_AT = r"(?:@|\s?\[\s?(?:at|AT|At|@)\s?\]\s?|\s?\(\s?(?:at|AT|At|@)\s?\)\s?|\s?\{\s?(?:at|AT)\s?\}\s?|\s?<(?:at|AT)>\s?|&#64;|&#x40;|%40| AT | at )"
_DOT = r"(?:\.|\s?\[\s?(?:dot|DOT|Dot|\.)\s?\]\s?|\s?\(\s?(?:dot|DOT|Dot|\.)\s?\)\s?|\s?\{\s?(?:dot|DOT)\s?\}\s?| DOT | dot )"
_TLD = r"[A-Za-z]{2,24}"
EMAIL = re.compile(rf"(?<![\w.+@/%-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{0,6}}?{_DOT}{_TLD}(?![A-Za-z0-9_@-])(?!{_DOT}[A-Za-z0-9])")
_AT_HINT = re.compile(r"@|[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]| AT | at |&#64;|&#x40;|%40")
_SPOKEN = re.compile(r" (?:at|AT) ")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses; remotes (user@host:path), versions and handles are none."""
    out, done = [], 0
    for hint in _AT_HINT.finditer(text):
        if hint.start() < done:
            continue
        low = max(0, hint.start() - 70)
        # start at the local part that ends right before the sign
        begin = hint.start()
        while begin > low and (text[begin - 1].isalnum() and text[begin - 1].isascii() or text[begin - 1] in "._%+'-"):
            begin -= 1
        if begin == hint.start() and begin and text[begin - 1] == " ":
            begin -= 1
            while begin > low and (text[begin - 1].isalnum() and text[begin - 1].isascii() or text[begin - 1] in "._%+'-"):
                begin -= 1
        while begin < hint.start() and not text[begin].isalnum():
            begin += 1
        m = EMAIL.match(text, begin)
        if not m:
            continue
        found = m.group()
        sign = found[hint.start() - begin :]
        if _SPOKEN.match(sign) and not re.search(r" (?:dot|DOT) |[\[({](?:dot|DOT)", found):
            continue  # "answers at shop.example" is no address
        after = text[m.end() : m.end() + 2]
        if after[:1] == ":" and after[1:2].strip() and after[1:2] not in "\"'`,;)":
            continue  # a remote
        out.append(m.span())
        done = m.end()
    return out


# ---------------------------------------------------------------- phones and identity numbers

_NUMBER = re.compile(
    r"(?<![\w.,:/#@+-])(?:(?:\+|00)[1-9]\d{0,2}[ \xa0./-]?|1[ .-](?=\())?(?:\(\d{1,5}\)[ \xa0./-]?)?\d{1,5}(?:[ \xa0./-]\d{1,5}){1,6}(?![\w]|[.,:/-]\d|%)"
    r"|(?<![\w.,:/#@+-])(?:\+|00)[1-9]\d{8,14}(?!\w)"
    r"|(?<![\w.,:/#@+-])\(\d{2,5}\)[ \xa0./-]?\d{3,9}(?!\w)"
    r"|(?<![\w.:/#@+-])\d{8,15}(?![\w]|[.,:/-]\d)"
)
#: fixed values: words before numbers that are neither phones nor identities
_OTHER_WORD = re.compile(r"(?i)\b(?:build|version|release|rev|revision|rows?|lines?|zeile|ligne|línea|port|chunk|trace|span|host|ip|uuid|sha|commit|run|job|ticket|issue|pr|step|order|invoice|batch|page)(?: (?:id|no|nr|number))?\.?\s?[:#=]?\s?$")
#: fixed values: words that stand before a phone number, and before an identity number
_PHONE_WORD = re.compile(r"(?i)(?:\b(?:tel|tél|fon|phone|fax|mobile?|mobil|handy|call|ring|number is|numéro est|appeler|telefono|teléfono|llame|rufnummer|whatsapp|sms)\b[^\n\d]{0,30})$")
_ID_WORD = re.compile(
    r"(?i)(?:\b(?:ssn|itin|tin|nino|nhs|social security|sécurité sociale|securite sociale|seguridad social|insee|nir|tax[ _-]?(?:id|number|no)|steuer-?(?:id|nummer|identifikationsnummer)|idnr|sozialversicherung\w*|"
    r"passport|passeport|pasaporte|reisepass|ausweis\w*|personalausweis|identity|identité|identidad|identitätsnummer|national id|id card|carte d.identité|dni|nie|nif|cni|curp|rfc|numéro fiscal|nif/nie|"
    r"record of|(?<!trace )(?<!request )(?<!span )(?<!build )(?<!commit )(?<!session )(?<!event )(?<!message )(?<!thread )(?<!process )(?<!job )(?<!task )(?<!node )(?<!object )(?<!order )id)\b[\s:=#.'\"]*(?:n[o°º]\.?|nr\.?|num(?:ber|éro|ero)?|is|:|=)*[\s:='\"]*)$"
)
_SSN = re.compile(r"(?<![\w.+-])\d{3}([- .])\d{2}\1\d{4}(?![\w]|[-.]\d)")
_NIR = re.compile(r"(?<![\w.+-])\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\w)")
_STEUER = re.compile(r"(?<![\w.+-])\d{2} \d{3} \d{3} \d{3}(?![\w]| \d)")
_DNI = re.compile(r"(?<![\w.+-])(?:\d{8}|\d{2}\.\d{3}\.\d{3})[ -]?[A-HJ-NP-TV-Z](?!\w)|(?<![\w.+-])[XYZ][ -]?\d{7}[ -]?[A-Z](?!\w)")
_COMPACT = re.compile(r"(?<![\w./+-])(?=[A-Z0-9]{0,14}\d)[A-Z]{1,3}[0-9A-Z]{6,14}(?![\w-])|(?<![\w./+-])(?=[A-Z0-9]{0,14}[A-Z])\d[0-9A-Z]{6,14}(?![\w-])")


_RUN = re.compile(r"\d[\d \xa0().\-/\n]{4,}\d|\d{4}[-. ]?[A-Z]|[A-Z0-9]{7,15}")


def _phone_like(s: str, before: str) -> bool:
    """Whether a group of digits has the format of a phone number."""
    digits = re.sub(r"\D", "", s)
    if s[0] == "+" or s.startswith("00"):
        return 9 <= len(digits) <= 15
    if _PHONE_WORD.search(before) and 7 <= len(digits) <= 15:
        return True
    if "(" in s:
        return 8 <= len(digits) <= 13
    groups = re.split(r"[\s./-]+", s)
    sizes = [len(g) for g in groups]
    if len(groups) == 1:
        return False
    if groups[0] == "1" and len(groups) > 1:
        groups, sizes = groups[1:], sizes[1:]
    if sizes == [3, 3, 4]:  # the North American plan: area and exchange start with 2 to 9
        return groups[0][0] in "23456789" and groups[1][0] in "23456789" and s.count(".") != 1
    if groups[0][0] == "0" and 9 <= len(digits) <= 13 and len({c for c in s if not c.isdigit()}) <= 3:
        return sizes[0] >= 2 and all(x >= 2 for x in sizes)
    return len(digits) == 9 and sizes in ([3, 3, 3], [3, 2, 2, 2], [2, 3, 2, 2]) and groups[0][0] in "6789" and "." not in s


def numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(phones, identity numbers) as spans."""
    ids: list[tuple[int, int]] = []
    taken = Taken()

    def labelled(a: int) -> bool:
        return bool(_ID_WORD.search(text[max(0, a - 40) : a]))

    def other(a: int) -> bool:
        return bool(_OTHER_WORD.search(text[max(0, a - 24) : a]))

    # only neighbourhoods of long runs of digits or capitals are looked at closely
    near: list[list[int]] = []
    for m in _RUN.finditer(text):
        a, b = max(0, m.start() - 10), m.end() + 10
        if near and a <= near[-1][1]:
            near[-1][1] = b
        else:
            near.append([a, b])
    for pattern, needs_label in ((_SSN, False), (_NIR, True), (_STEUER, True), (_DNI, True), (_COMPACT, True)):
        for m in (m for a, b in near for m in pattern.finditer(text, a, b)):
            a, b = m.span()
            if (labelled(a) or not (needs_label or other(a))) and taken.free(a, b):
                ids.append((a, b))
                taken.add(a, b)
    phones: list[tuple[int, int]] = []
    for m in (m for a, b in near for m in _NUMBER.finditer(text, a, b)):
        a, b = m.span()
        if not taken.free(a, b):
            continue
        s, before = m.group(), text[max(0, a - 40) : a]
        digits = sum(c.isdigit() for c in s)
        if labelled(a) and 7 <= digits <= 18 and not _PHONE_WORD.search(before):
            ids.append((a, b))
        elif not other(a) and _phone_like(s, before):
            phones.append((a, b))
        else:
            continue
        taken.add(a, b)
    return phones, ids


# ---------------------------------------------------------------- addresses

_CAP = r"[A-ZÀ-ÖØ-Þ][\wß-ÿ'’-]+"
#: fixed values: kinds of streets
_EN_KIND = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Terrace|Ter|Court|Ct|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Crescent|Cres|Row|Hill|Gardens|Grove|Mews|Park|Walk|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Trail|Alley|Quay|Rise|View|Green)"
_DE_KIND = r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|steig|stieg|chaussee|graben|markt|wall|pfad|promenade|kai|berg|hof|winkel|tor|brücke|twiete)"
_FR_KIND = r"(?:rue|avenue|av\.|boulevard|bd\.?|boul\.|chemin|place|pl\.|impasse|allée|quai|cours|sentier|route|rte\.?|square|passage|faubourg|esplanade|promenade|villa|cité)"
_ES_KIND = r"(?:[Cc]alle|[Cc]/|[Aa]vda\.?|[Aa]v\.|[Aa]venida|[Pp]laza|[Pp]za\.?|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía|[Cc]arretera|[Cc]tra\.|[Cc]ostanilla|[Gg]lorieta|[Rr]ambla|[Cc]allejón|P\.º)"
_NO = r"\d{1,4}(?:[A-Za-z](?![A-Za-z]))?(?:\s?[-–/]\s?\d{1,4}[A-Za-z]?)?"
_EN = re.compile(rf"(?<![\w.,/#-])(?<!\d ){_NO},? (?:(?:{_CAP}|[NSEW]\.?|\d{{1,3}}(?:st|nd|rd|th)) ){{1,4}}{_EN_KIND}\b(\.?)(?! [a-z]+ (?:fixture|kind))")
_DE = re.compile(
    rf"(?<![\w-])(?:[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*-?{_DE_KIND}|(?:[A-ZÄÖÜ][a-zäöüß]+(?:er|e|es|en) )(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ufer|Ring|Damm|Chaussee|Markt|Steig|Graben)|[A-ZÄÖÜ][a-zäöüß-]+-(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ufer|Ring|Damm)"
    rf"|(?:Am|An der|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Unter der|Hinter der|Hinter dem|Bei der|Beim) [A-ZÄÖÜ][a-zäöüß]+(?: [A-ZÄÖÜ][a-zäöüß]+)?) \d{{1,4}}(?:\s?[-–/]\s?\d{{1,4}})?(?:\s?[a-z](?![\w]))?(?!\w|[.,]\d)"
)
_FR = re.compile(
    rf"(?<![\w.,/#-])\d{{1,4}}(?:\s?[-–/]\s?\d{{1,4}})?(?:\s?(?:bis|ter|quater|[A-Da-d])\b)?,?\s(?:{_FR_KIND}|{_FR_KIND[3:-1].join(('(?i:', ')'))})(?:\s(?:de la|de l['’]|des|du|de|d['’]|la|le|les|aux?|à la|et|en|sur|sous))*"
    rf"(?:(?:\s|(?<=['’])){_CAP}(?:\s(?:de la|de l['’]|des|du|de|d['’]|et))*)+"
)
_ES = re.compile(rf"(?<!\w){_ES_KIND}\s(?:(?:de las|de los|de la|del|de|la|el|los|las|y|San|Santa)\s)*{_CAP}(?:\s(?:(?:de las|de los|de la|del|de|y)\s)?{_CAP})*(?:,\s?|\s)(?:(?:n\.?\s?[º°o]\.?|núm\.?|número|nº)\s?)?\d{{1,4}}(?:\s?(?:bis|[A-Z](?![\w])))?(?!\w|[.,]\d)")


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans of a street with its house number, without flat, postcode and town."""
    out = []
    for m in _EN.finditer(text):
        a, b = m.span()
        if m.group(1):
            rest = text[b : b + 2]
            own_line = (a == 0 or text[a - 1] == "\n") and rest[:1] in ("", "\n")
            kind_full = re.search(r"(?:St|Rd|Ave|Ln|Dr|Ter|Ct|Pl|Sq|Blvd|Cres|Pkwy|Cir|Hwy)\.$", m.group())
            inside = rest[:1] in (".", ",") or (rest[:1] == " " and rest[1:2].islower()) or own_line
            if not (kind_full and inside):
                b -= 1
        out.append((a, b))
    for pattern in (_DE, _FR, _ES):
        out += [m.span() for m in pattern.finditer(text)]
    return out


# ---------------------------------------------------------------- names

#: Capital and small letters of Latin, Greek and Cyrillic; other scripts have none.
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀ-ĿΑ-ΫА-ЯЁ", "a-zß-öø-ÿā-ſά-ώа-яё"
_TOKEN = re.compile(rf"(?<![\w@])[{_UP}](?:['’][{_UP}])?(?:[{_LOW}]+|[{_UP}ß]+)(?:-[{_UP}](?:[{_LOW}]+|[{_UP}ß]+))*(?!\w)")
_GAP = re.compile(rf" (?:[{_UP}]\.? ){{0,2}}(?:(?:van|von|de|der|den|da|del|di|la|le|y) ){{0,2}}")
_INITIAL = re.compile(rf"(?<![\w.])(?:[{_UP}]\.[ -]?){{1,2}}$")
_AFTER = re.compile(rf"(?: [{_UP}]\.){{1,2}}(?!\w)")
#: fixed values: titles, which are not part of a name and tell gender
_HE = {"mr", "herr", "sr", "señor", "monsieur", "don"}
_SHE = {"mrs", "ms", "miss", "mme", "mlle", "frau", "sra", "srta", "señora", "madame", "doña"}
_TITLES = _HE | _SHE | {"dr", "prof", "dra", "ing", "sir", "madam"}


def name_words(full: str) -> tuple[str, str] | None:
    """The given and the family name of a labelled full name, without case; None if it has no two."""
    parts = [p for p in full.split() if not re.fullmatch(r"\w\.?", p)]
    if len(parts) >= 2 and all(p[0].isupper() and not any(c.isdigit() for c in p) for p in parts):
        return parts[0].casefold(), parts[-1].casefold()
    return None


class NameModel:
    """Given names, family names and a character-trigram score of being a name.

    Fitted to labelled full names ("Given Family") against ordinary words, of
    each at most :data:`MOST_NAMES` and :data:`MOST_WORDS`. A token unknown to
    both lists is name-like if the mean log odds of its trigrams under the two
    kinds of words exceed 0. ``given`` and ``family`` are the lists of all known
    names; without them, those of the fitted ones.
    """

    def __init__(self, names: Iterable[str], words: Iterable[str], given: Iterable[str] | None = None, family: Iterable[str] | None = None) -> None:
        pairs = [p for p in map(name_words, sorted(set(filter(None, names)))[:MOST_NAMES]) if p]
        fitted = {p[0] for p in pairs} | {p[1] for p in pairs}
        self.given = set(given) if given is not None else {p[0] for p in pairs}
        self.family = set(family) if family is not None else {p[1] for p in pairs}
        ordinary = {w.casefold() for w in sorted(set(filter(None, words)))[:MOST_WORDS]} - fitted
        self.words = ordinary
        self._name, self._word = self._grams(fitted), self._grams(ordinary)
        self._cache: dict[str, float] = {}

    def knowing(self, given: Iterable[str], family: Iterable[str]) -> NameModel:
        """The same score with other lists of known names."""
        out = object.__new__(NameModel)
        out.__dict__.update(self.__dict__, given=set(given), family=set(family))
        return out

    @staticmethod
    def _grams(tokens: set[str]) -> tuple[Counter, float]:
        c = Counter(f"^{t}$"[i : i + 3] for t in tokens for i in range(len(t)))
        return c, math.log(sum(c.values()) + 2_000)

    def score(self, token: str) -> float:
        t = token.casefold()
        if t not in self._cache:
            if len(self._cache) > 200_000:
                self._cache.clear()
            (a, an), (b, bn) = self._name, self._word
            grams = [f"^{t}$"[i : i + 3] for i in range(len(t))]
            self._cache[t] = sum(math.log(a[g] + 0.5) - an - math.log(b[g] + 0.5) + bn for g in grams) / len(grams)
        return self._cache[t]

    def _likely(self, token: str, known: set[str], least: float) -> bool:
        t = token.casefold()
        return t in known or (t not in self.words and t not in _TITLES and len(t) > 2 and self.score(token) > least)

    def pair(self, first: str, last: str) -> bool:
        a, b = first.casefold() in self.given, last.casefold() in self.family
        if a and b:
            return True
        if a:
            return self._likely(last, self.family, 0.0)
        if b:
            return self._likely(first, self.given, 0.0)
        return False

    def alone(self, last: str) -> bool:
        """Whether a token after an initial is a family name."""
        return self._likely(last, self.family, 1.0)


def names(text: str, model: NameModel, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of given name or initial with family name, either order, outside ``taken``."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out: list[tuple[int, int]] = []
    spans = sorted(taken)
    k = i = 0
    known = model.given | model.family
    while i < len(tokens):
        a, b = tokens[i]
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            i += 1
            continue
        word = text[a:b]
        low = word.casefold()
        following = tokens[i + 1] if i + 1 < len(tokens) and tokens[i + 1][0] - b <= 14 else None
        if following and k < len(spans) and spans[k][0] < following[1]:
            following = None
        if following and low not in _TITLES:
            c, d = following
            gap, other = text[b:c], text[c:d]
            fits = (low in known or other.casefold() in known) and gap[:1] == " " and _GAP.fullmatch(gap) and model.pair(word, other)
            if fits and low not in model.given:
                # an unknown word before a known family name: no particle between, and no "Family, Given" after it
                fits = not re.search(r"[a-z]", gap) and not (i + 2 < len(tokens) and text[d : tokens[i + 2][0]] == ", " and text[slice(*tokens[i + 2])].casefold() in model.given)
            if fits:
                out.append((a, d))
                i += 2
                continue
            if gap == ", " and other.casefold() in model.given and model._likely(word, model.family, 0.5) and not (i and low in model.given and low not in model.family):
                m = _AFTER.match(text, d)
                out.append((a, m.end() if m else d))
                i += 2
                continue
        if low in model.family or low not in model.given:
            before = text[max(0, a - 8) : a]
            m = _INITIAL.search(before) if before.endswith((". ", ".", "-")) else None
            if m and model.alone(word):
                out.append((a - len(m.group()), b))
            elif low in model.family:
                m = re.match(rf", (?:[{_UP}]\.)(?: ?[{_UP}]\.)?(?!\w)", text[b : b + 10])
                if m:
                    out.append((a, b + m.end()))
        i += 1
    return out


# ---------------------------------------------------------------- the whole


def find(text: str, model: NameModel) -> list[tuple[int, int, str]]:
    """(start, end, type) of all entities, in order and without overlap."""
    found: list[tuple[int, int, str]] = []
    taken = Taken()

    def add(spans: list[tuple[int, int]], kind: str) -> None:
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if taken.free(a, b):
                found.append((a, b, kind))
                taken.add(a, b)

    add(emails(text), "email")
    phones, ids = numbers(text)
    add(ids, "id_number")
    add(phones, "phone")
    add(addresses(text), "address")
    add(names(text, model, [(a, b) for a, b, _ in found]), "name")
    return sorted(found)


@dataclass
class KnownNames:
    """A fitted score, and all known names: held, or as a table (word, given, family) that is too long to hold."""

    model: NameModel
    words: DataFrame | None = None

    def rows(self, documents: DataFrame) -> DataFrame:
        """(doc_id, text, given, family): documents with the known names among their words, null where the model holds all."""
        docs = documents.select("doc_id", "text")
        none = F.lit(None).cast("array<string>")
        if self.words is None:
            return docs.select("doc_id", "text", none.alias("given"), none.alias("family"))
        # equal texts share one key, so that copies are split once; a lower-cased token is what find() looks up
        docs = docs.withColumn("t", F.xxhash64("text")).withColumn("u", F.xxhash64(F.lit(1), "text"))
        tokens = docs.where("text is not null").dropDuplicates(["t", "u"]).select("t", "u", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}'’-]{2,}"), 0), casefolded))).alias("word"))
        hits = tokens.join(self.words, "word")
        own = hits.groupBy("t", "u").agg(F.collect_list(F.when(F.col("given"), F.col("word"))).alias("given"), F.collect_list(F.when(F.col("family"), F.col("word"))).alias("family"))
        own = docs.join(own, ["t", "u"], "left")
        return own.select("doc_id", "text", F.coalesce("given", F.array().cast("array<string>")).alias("given"), F.coalesce("family", F.array().cast("array<string>")).alias("family"))

    def of(self, given, family) -> NameModel:
        return self.model if given is None else self.model.knowing(given, family)


def casefolded(word: "F.Column") -> "F.Column":
    """As str.casefold for letters of Latin, Greek and Cyrillic names."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "ß", "ss"), "ς", "σ")


def find_personal(documents: DataFrame, model: NameModel | KnownNames, id_type: str = "bigint") -> DataFrame:
    """(doc_id, pii_type, pii_value, start, end) of every entity in every text.

    documents: (doc_id, text); further columns are not read. Null, empty and
    blank texts give no rows; repeated rows give repeated results.
    """
    cols = ["doc_id", "pii_type", "pii_value", "start", "end"]
    known = model if isinstance(model, KnownNames) else KnownNames(model)
    own = KnownNames(known.model)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, kind, t[a:b], a, b) for d, t, g, f in batch.itertuples(index=False) for a, b, kind in find(t, own.of(g, f))], columns=cols)

    return known.rows(documents.where("text is not null")).mapInPandas(search, f"doc_id {id_type}, pii_type string, pii_value string, start int, end int")


#: Scripts whose names are spelled in syllables: their letters, vowels and consonants.
_SCRIPTS = [
    ("abcdefghijklmnopqrstuvwxyz", "aeiouy", "bcdfghjklmnpqrstvwxz"),
    ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    ("αβγδεζηθικλμνξοπρστυφχψω", "αεηιουω", "βγδζθκλμνξπρστφχψ"),
]


class Surrogates:
    """Keyed replacements that keep shape, case and separators."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self._done: dict[tuple[str, str, str], str] = {}

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, repr(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()[:16], "big")

    def permute(self, s: str, alphabet: str, tag: str) -> str:
        """A keyed permutation of the strings of one length over an alphabet (Feistel, 10 rounds)."""
        n = len(alphabet)
        place = {c: i for i, c in enumerate(alphabet)}
        if len(s) == 1:
            order = sorted(range(n), key=lambda i: self._number(tag, "one", i))
            return alphabet[order[place[s]]]
        half = len(s) // 2
        left, right = [place[c] for c in s[:half]], [place[c] for c in s[half:]]
        for r in range(10):
            f = self._number(tag, r, len(s), tuple(right))
            mixed = []
            for x in left:
                f, y = divmod(f, n) if f else (self._number(tag, r, x, f), 0)
                mixed.append((x + y) % n)
            left, right = right, mixed
        if len(left) != half and 10 % 2:
            left, right = right, left
        return "".join(alphabet[x] for x in left + right)

    def digits(self, value: str, keep: int = 0) -> str:
        """Digits permuted, everything else in place; the first ``keep`` digits stay."""
        at = [i for i, c in enumerate(value) if c.isdigit() and c.isascii()][keep:]
        new = self.permute("".join(value[i] for i in at), "0123456789", f"d{len(at)}") if at else ""
        out = list(value)
        for i, c in zip(at, new, strict=True):
            out[i] = c
        return "".join(out)

    def word(self, value: str, tag: str, ending: str = "") -> str:
        """:meth:`spelled`, remembered: names return often."""
        at = (value, tag, ending)
        if at not in self._done:
            if len(self._done) > 100_000:
                self._done.clear()
            self._done[at] = self.spelled(*at)
        return self._done[at]

    def spelled(self, value: str, tag: str, ending: str = "") -> str:
        """A pronounceable word for a name, one to one for each tag and ending, in the case pattern given.

        The first letter of the result depends on the first letter of the value
        alone. Letters are permuted in their script and spelled in syllables (two
        letters in three, a last one in two); marks stay on their letters. Letters
        of scripts without such syllables are permuted among their neighbours.
        """
        base, marks = [], {}
        for c in unicodedata.normalize("NFD", value.casefold()):
            if unicodedata.combining(c) and base:
                marks[len(base) - 1] = marks.get(len(base) - 1, "") + c
            else:
                base.append(c)
        script = next((x for x in _SCRIPTS if all(c in x[0] for c in base)), None)
        if not script:
            return "".join(self._apart(c, tag) for c in value)
        letters, vowels, consonants = script
        first = self.permute(base[0], letters, "first")
        rest = self.permute("".join(base[1:]), letters, f"{tag}{len(letters)}-{len(base) - 1}") if len(base) > 1 else ""
        out = [first + marks.get(0, "")]
        v, c = len(vowels), len(consonants)
        for i in range(0, len(rest), 2):
            two = rest[i : i + 2]
            x = letters.index(two[0]) * (len(letters) if len(two) == 2 else 1) + (letters.index(two[1]) if len(two) == 2 else 0)
            out.append(vowels[x % v] + marks.get(i + 1, "") + consonants[x // v % c])
            if len(two) == 2:
                out.append(vowels[x // v // c] + marks.get(i + 2, ""))
        s = unicodedata.normalize("NFC", "".join(out) + ending)
        return s.upper() if value.isupper() and len(value) > 1 else s.capitalize() if value[:1].isupper() else s

    def _apart(self, c: str, tag: str) -> str:
        """A letter of another script, permuted among the letters of its block of 256."""
        if not c.isalpha():
            return c
        block = [chr(x) for x in range(ord(c) & ~255, (ord(c) | 255) + 1) if unicodedata.category(chr(x)) == unicodedata.category(c)]
        return self.permute(c, "".join(block), f"{tag}{block[0]}")

    def letters(self, value: str) -> str:
        """Letters and digits of a value permuted run by run, case by case."""

        def run(m: re.Match) -> str:
            s = m.group()
            if s[0].isdigit():
                return self.permute(s, "0123456789", f"d{len(s)}")
            new = self.permute(s.lower(), "abcdefghijklmnopqrstuvwxyz", f"a{len(s)}")
            return "".join(n.upper() if o.isupper() else n for o, n in zip(s, new, strict=True))

        return re.sub(r"[A-Za-z]+|[0-9]+", run, value)

    def email(self, value: str) -> str:
        parts = re.split(r"((?:\s?[\[({<]\s?(?:at|dot|AT|DOT|At|Dot|@|\.)\s?[\])}>]\s?)| AT | DOT | at | dot |@|\.)", value)
        last = len(parts) - 1
        return "".join(p if i % 2 or i == last else self.letters(p) for i, p in enumerate(parts))

    def phone(self, value: str) -> str:
        m = re.match(r"(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(?:[ .-]?\(0\))?", value)
        keep = sum(c.isdigit() for c in m.group()) if m else int(bool(re.match(r"\(?0", value)))
        return self.digits(value, keep)

    def name(self, value: str, female: bool | None) -> str:
        given = 0 if "," not in value else value.find(",") + 2

        def part(m: re.Match) -> str:
            s = m.group()
            if len(s) == 1:
                return self.word(s, "initial")
            ending = "" if female is None or m.start() != given or len(s) < 3 or not s.isascii() else "a" if female else "o"
            return self.word(s, "given" if m.start() == given else "name", ending)

        return re.sub(r"[^\W\d_]+", part, value)

    def address(self, value: str) -> str:
        def part(m: re.Match) -> str:
            s = m.group()
            known = re.fullmatch(rf"{_EN_KIND}|{_FR_KIND}|{_ES_KIND}|[a-z]+|[A-Z]|bis|ter|Calle|Am|An|Im|Zum|Zur", s)
            if known:
                return s
            kind = re.search(rf"{_DE_KIND}$", s)
            return self.word(s[: kind.start()], "street") + kind.group() if kind and kind.start() else self.word(s, "street")

        return self.digits(re.sub(r"[^\W\d_]+", part, value))

    def replace(self, text: str, found: list[tuple[int, int, str]]) -> str:
        """``text`` with each entity replaced by ``[type surrogate]``; all else is kept.

        A given name has one gender in a document: that of a title before it
        somewhere, else that of its ending.
        """
        title: dict[str, bool] = {}
        for a, b, kind in found:
            if kind == "name" and (m := re.search(r"(\w+)\.? $", text[max(0, a - 10) : a])) and (t := m.group(1).casefold()) in _HE | _SHE:
                title.setdefault(_given(text[a:b]), t in _SHE)
        out, last = [], 0
        for a, b, kind in found:
            value = text[a:b]
            if kind == "name":
                first = _given(value)
                female = title.get(first, first.endswith(("a", "e", "ie", "y")) if len(first) > 2 else None)
                new = self.name(value, female)
            else:
                new = {"email": self.email, "phone": self.phone, "id_number": self.letters, "address": self.address}[kind](value)
            out += [text[last:a], f"[{kind} {new}]"]
            last = b
        return "".join([*out, text[last:]])


def _given(value: str) -> str:
    """The given name or initial of a name, in either order, without case."""
    return value.split(", ")[-1].split()[0].casefold()


def redact(documents: DataFrame, model: NameModel | KnownNames, key: bytes, id_type: str = "bigint") -> DataFrame:
    """(doc_id, text, entities): every text with its entities replaced; a null text stays null."""
    surrogates = Surrogates(key)
    known = model if isinstance(model, KnownNames) else KnownNames(model)
    own = KnownNames(known.model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, t, g, f in batch.itertuples(index=False):
                found = find(t, own.of(g, f)) if t is not None else []
                rows.append((d, surrogates.replace(t, found) if found else t, len(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "entities"])

    return known.rows(documents).mapInPandas(run, f"doc_id {id_type}, text string, entities int")
