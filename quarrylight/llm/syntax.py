"""Source files that do not parse.

A body is parsed by generalised LL (:mod:`quarrylight.llm.gll`) under the grammar
of the language its file unit names, and flagged if that rejects it. The parser
could run the start symbols of several dialects together, but one dialect of each
language is asked for: Python 3, JavaScript modules, TypeScript, Java, Go and
strict JSON. Where a slash in JavaScript may divide or begin a pattern, both
readings are tried.

To make that affordable, the parser works on islands. A lexer turns the text into
one character for each token; a bracketed group holds no part of a rule outside
it, so groups are parsed from the innermost outwards and replaced by a character
that stands for the set of nonterminals they derive. Statements that a mark ends
are parsed one by one, with the whole sequence as a second way. Each shape of
tokens is parsed once in a worker and remembered; files repeat few shapes.

Bodies are deduplicated by content hash before parsing and joined back after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import grammars
from quarrylight.llm.gll import Grammar

#: Entries a worker remembers of each kind before it starts afresh.
MOST_REMEMBERED = 300_000

_OPENERS = {"(": "p", "[": "b", "{": "c"}
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_AREA = {"p": 0xE000, "b": 0xE800, "c": 0xF000}  # private characters for groups of each bracket
_GROUP = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_RUN = re.compile(r"(,[^,]{1,5})\1{3,}")
ANY_C = "[\uf000-\uf7ff]"

#: fixed values: reserved words, which cannot be identifiers
RESERVED = {
    "json": "true false null",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let static yield await implements interface package private protected public",
    "typescript": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let yield await",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
}

_JS_STRING = r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"


def _inserted(depth: int) -> str:
    """What may stand in the braces of a template, with braces and templates in it to a depth."""
    plain = r"[^{}`'\"]|" + _JS_STRING
    if not depth:
        return rf"(?:{plain})*"
    return rf"(?:{plain}|\{{{_inserted(depth - 1)}\}}|{_template(depth - 1)})*"


def _template(depth: int) -> str:
    return r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{" + _inserted(depth) + r"\})*`"


#: Parameter: levels of braces and templates inside the braces of a template.
_INSERTED = _inserted(4)
_JS_TEMPLATE = _template(4)
_JS_BEFORE_REGEX = r"(?:=>|&&|\|\||\?\?|[=(,:;!&|?{}\[+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|else|do|instanceof|yield|await)\b)"
_JS_REGEX_BODY = r"\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*"
_JS_REGEX = _JS_BEFORE_REGEX + _JS_REGEX_BODY
_C_COMMENT = r"//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/"
_PY_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_DIGITS = r"\d(?:_?\d)*"

LEXERS = {
    "json": r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\w+|[^ \t\r\n]",
    "python": _PY_PREFIX + r"(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|[^\W\d]\w*|\r?\n[ \t\f]*|#[^\n\r]*|\\\r?\n"
    rf"|0[xX](?:_?[0-9a-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?(?!\w)|{_DIGITS}[eE][+-]?{_DIGITS}[jJ]?(?!\w)|{_DIGITS}[jJ](?!\w)|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?!\w)"
    r"|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|[-+*/%@&|^=<>!]=|\*\*|//|<<|>>|[^\s]",
    "javascript": _C_COMMENT + "|" + _JS_TEMPLATE + "|" + _JS_STRING + "|" + _JS_REGEX + r"|\.\.\.|\?\.(?!\d)\s*[^\W\d][\w$]*|(?<!\.)\.\s*(?:[^\W\d]|\$)[\w$]*"
    r"|0[xX](?:_?[0-9a-fA-F])+n?(?![\w$])|0[bB](?:_?[01])+n?(?![\w$])|0[oO](?:_?[0-7])+n?(?![\w$])|(?:0|[1-9](?:_?\d)*)n(?![\w$])|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?(?![\w$])"
    r"|#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*|[\n\r\u2028\u2029]+"
    r"|>>>=|\*\*=|&&=|\|\|=|\?\?=|<<=|>>=|===|!==|=>|\?\.|\+\+|--|\*\*|&&|\|\||\?\?|<<|[-+*/%&|^=<>!]=|[^\s\ufeff]",
    "java": r"//[^\n\r]*|/\*[\s\S]*?\*/|\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n\r]|\\(?:[btnfrs0-7\"'\\]|u+[0-9a-fA-F]{4}))*\"|'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'"
    r"|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?(?![\w$])|0[bB][01_]+[lL]?(?![\w$])|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?(?![\w$])"
    r"|(?:[^\W\d]|\$)[\w$]*|>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||<<|[-+*/%&|^=<>!]=|[^\s\x1a]",
    "go": r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"
    r"|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?(?!\w)|0[bB][01_]+i?(?!\w)|0[oO][0-7_]+i?(?!\w)|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?(?!\w)"
    r"|[^\W\d]\w*|\n+|<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||<<|>>|&\^|[-+*/%&|^=<>!]=|[^ \t\r\n]",
}
LEXERS["typescript"] = LEXERS["javascript"]
#: The other reading of a slash: after a closing bracket it begins a pattern.
_JS_OTHER = LEXERS["javascript"].replace(_JS_REGEX, _JS_REGEX.replace("[=(,:;", "[=)}(,:;", 1))


class Rejected(Exception):
    """No dialect accepts the text."""


@dataclass
class Parser:
    """Lexer, grammar and memory for one language."""

    language: str
    grammar: Grammar = field(init=False)

    def __post_init__(self) -> None:
        self.grammar = Grammar(getattr(grammars, self.language.upper()))
        self.reserved = set(RESERVED[self.language].split())
        self.pattern = re.compile(LEXERS[self.language])
        self.masks: dict[str, int] = {}  # token character -> mask of terminals
        self.known: dict[frozenset[str], str] = {}
        self.areas = dict(_AREA)
        self.free = 0x100
        self.words = {t for t in self.grammar.bits if re.fullmatch(r"[a-z_A-Z]+", t)}
        self.lexemes = _Lexemes(self)
        self.groups: dict[str, str] = {}
        self.shapes: dict[tuple[str, str], bool] = {}
        self.lines: dict[str, str] = {}

    # -- characters

    def char(self, *terminals: str, area: str = "") -> str:
        """The character that stands for a token which is all of ``terminals``."""
        key = frozenset(terminals)
        if key not in self.known:
            if area:
                c, self.areas[area] = chr(self.areas[area]), self.areas[area] + 1
            else:
                c, self.free = chr(self.free), self.free + 1
            self.known[key] = c
            mask = 0
            for t in terminals:
                if t in self.grammar.bits:
                    mask |= 1 << self.grammar.bits[t]
            self.masks[c] = mask
        return self.known[key]

    def word(self, w: str) -> str:
        """A word: reserved, or an identifier that may also be a contextual keyword."""
        names = ["NAME"]
        if w in self.words and w not in ("ID", "NUM", "STR", "NAME", "NL", "END"):
            names.append(w)
        if w not in self.reserved:
            names.append("ID")
        elif w not in self.words:
            names.append("?" + w)
        return self.char(*names)

    # -- parsing of shapes

    def derives(self, name: str, shape: str) -> bool:
        key = (name, shape)
        out = self.shapes.get(key)
        if out is None:
            if len(self.shapes) > MOST_REMEMBERED:
                self.shapes.clear()
            masks = self.masks
            out = self.shapes[key] = self.grammar.derives(name, [masks.get(c, 0) for c in shape])
        return out

    def group(self, m: re.Match) -> str:
        """The character of a group, by the nonterminals its inside derives."""
        s = m.group()
        out = self.groups.get(s)
        if out is None:
            if len(self.groups) > MOST_REMEMBERED:
                self.groups.clear()
            if s[-1] != _CLOSER[s[0]]:
                raise Rejected
            letter = _OPENERS[s[0]]
            inside = self.inside(letter, s[1:-1])
            inside = _RUN.sub(r"\1\1\1", inside)  # a longer list of the same items is no other case
            names = [f"{letter}:{n}" for n in self.grammar.groups[letter] if self.sequence(n, inside)]
            if not names:
                raise Rejected
            out = self.groups[s] = self.char(*names, area=letter)
        return out

    def inside(self, letter: str, s: str) -> str:
        return s

    def sequence(self, name: str, s: str) -> bool:
        return self.derives(name, s)

    def reduced(self, s: str) -> str:
        """``s`` with all groups replaced; a bracket left over rejects it."""
        n = 1
        while n:
            s, n = _GROUP.subn(self.group, s)
        if re.search(r"[()\[\]{}]", s):
            raise Rejected
        return s

    def lex(self, text: str) -> str:
        if len(self.lexemes) > MOST_REMEMBERED:
            self.lexemes.clear()
        return "".join(map(self.lexemes.__getitem__, self.pattern.findall(text)))

    def token(self, t: str) -> str:
        """Characters of a token that was not seen before."""
        if t in "()[]{}":
            return t
        c = t[0]
        if c.isalpha() or c in "_$":
            return self.word(t)
        if c.isdigit() or (c == "." and t[1:2].isdigit()):
            return self.char("NUM")
        return self.char(t) if t in self.grammar.bits else self.char("?")

    def check(self, text: str) -> None:
        """Raises :class:`Rejected` unless a dialect accepts ``text``."""
        raise NotImplementedError

    def accepts(self, text: str) -> bool:
        try:
            self.check(text.removeprefix("\ufeff"))
        except Rejected:
            return False
        return True


class _Lexemes(dict):
    """Token text -> its characters, made on first sight."""

    def __init__(self, parser: Parser) -> None:
        self.parser = parser

    def __missing__(self, t: str) -> str:
        out = self.parser.token(t)
        if len(t) < 200:
            self[t] = out
        return out


class Json(Parser):
    def token(self, t: str) -> str:
        if t[0] == '"' and len(t) > 1:
            return self.char("STR")
        if t in ("true", "false", "null"):
            return self.char("true")
        if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", t, re.A):
            return self.char("NUM")
        return t if t in "()[]{}" else self.char(t) if t in self.grammar.bits else self.char("?")

    def sequence(self, name: str, s: str) -> bool:
        if "," not in s or name not in ("Members", "Elems"):
            return self.derives(name, s)
        comma, part = self.char(","), "Pair" if name == "Members" else "Value"
        return all(self.derives(part, p) for p in set(s.split(comma)))

    def group(self, m: re.Match) -> str:
        if m.group()[0] == "(":
            raise Rejected
        return super().group(m)

    def check(self, text: str) -> None:
        if not self.derives("Value", self.reduced(self.lex(text))):
            raise Rejected


class Ecma(Parser):
    """JavaScript modules and TypeScript, with statement ends supplied where a line ends."""

    def __post_init__(self) -> None:
        super().__post_init__()
        self.nl, self.end, self.semi = self.char("NL"), self.char("END"), self.char(";")
        can_end = [self.char("NUM"), self.char("STR"), self.char("TEMPLATE"), self.char("REGEX"), self.char("PRIVATE"), self.char("++"), self.char("--"), *")]}"]
        can_end += [self.word(w) for w in ("this", "super", "null", "true", "false", "return", "break", "continue", "debugger", "void", "x")]
        self.words_as_id = sorted(w for w in self.words if w not in self.reserved and w.islower())
        can_end += [self.word(w) for w in self.words_as_id]
        if self.language == "typescript":
            can_end.append(self.char("!"))
        goes_on = [self.char(t) for t in ", . ?. : ; = + - * / % ** << < > <= >= == != === !== && || ?? & | ^ => ? += -= *= /= %= &&= ||= ??= ".split()] + [*"([{)]}"]
        goes_on += [self.word(w) for w in ("instanceof", "in", "catch", "finally", "extends", "implements", "as", "satisfies", "of")] + [self.char("TEMPLATE")]
        esc = lambda cs: "[" + "".join(re.escape(c) for c in dict.fromkeys(cs)) + "]"
        n = self.nl
        self.no_end = re.compile(f"(?<!{esc(can_end)}){n}|{n}(?={esc(goes_on)})|^{n}|{n}$|(?<=}}){n}(?={esc([self.word('else'), self.word('while')])})")
        self.inserted = re.compile(r"\\[\s\S]|\$\{(" + _INSERTED + r")\}")
        self.other = re.compile(_JS_OTHER)
        after_head = esc([self.word(w) for w in ("if", "while", "for")])
        self.head = re.compile(f"({after_head}{self.word('await')}?[\ue000-\ue7ff]){n}")
        self.cut = re.compile(f"(?<=[{self.semi}{n}])(?![{self.semi}{n}{self.word('else')}])")

    def token(self, t: str) -> str:
        c = t[0]
        if c in "\n\r\u2028\u2029":
            return self.nl
        if t.startswith("//"):
            return ""
        if t.startswith("/*") and len(t) > 3:
            return self.nl if "\n" in t else ""
        if c in "\"'" and len(t) > 1:
            return self.char("STR")
        if c == "`" and len(t) > 1:
            return self.template(t)
        if "/" in t and len(t) > 2 and (m := re.match(r"([^/]+?)\s*/(?!=$)", t)) and not t.startswith("//") and t not in ("/=",):
            return self.lexemes[m.group(1)] + self.char("REGEX")
        if c == "#" and len(t) > 1 and not t.startswith("#!"):
            return self.char("PRIVATE")
        if c == "." and len(t) > 1 and not t[1:2].isdigit() and t != "...":
            return self.char(".") + self.word("x")
        if t.startswith("?.") and len(t) > 2:
            return self.char("?.") + self.word("x")
        if c == "\\" and len(t) > 1:
            return self.word("x")
        return super().token(t)

    def template(self, t: str) -> str:
        """A template whose inner expressions parse, else a character that no rule has."""
        if "${" in t:
            for part in self.inserted.findall(t):
                try:
                    s = self.no_end.sub("", self.lex(part))
                    if not self.derives("Expr", self.reduced(s.replace(self.nl, ""))):
                        return self.char("?")
                except Rejected:
                    return self.char("?")
        return self.char("TEMPLATE")

    def inside(self, letter: str, s: str) -> str:
        return s.replace(self.nl, "") if letter != "c" else self.head.sub(r"\1", s)

    def sequence(self, name: str, s: str) -> bool:
        if name not in ("Stmts", "ClassBody"):
            return self.derives(name, s) or (name == "Cases" and self.derives(name, s + self.end))
        close = self.end if name == "Stmts" else self.nl  # the end of a body also ends its last statement
        parts = self.cut.split(s)
        last = parts.pop()
        if all(self.derives(name, p) for p in parts if p) and (self.derives(name, last) or self.derives(name, last + close)):
            return True
        return bool(parts) and (self.derives(name, s) or self.derives(name, s + close))

    def accepts(self, text: str) -> bool:
        if super().accepts(text):
            return True
        if not re.search(r"[)}]\s*/(?![*/])", text):
            return False
        usual, self.pattern = self.pattern, self.other
        try:
            return super().accepts(text)
        finally:
            self.pattern = usual

    def check(self, text: str) -> None:
        s = re.sub(f"{self.nl}+", self.nl, self.lex(re.sub(r"\A#![^\n]*", "", text)))
        s = self.no_end.sub("", self.no_end.sub("", s))
        s = self.head.sub(r"\1", self.reduced(s))
        if not self.sequence("Stmts", s):
            raise Rejected


class Units(Parser):
    """Languages whose files are a few kinds of declarations in order."""

    kinds: tuple[tuple[str, str], ...] = ()
    lists: tuple[str, ...] = ()
    cut: re.Pattern
    last = ""

    def sequence(self, name: str, s: str) -> bool:
        if name not in self.lists:
            return self.derives(name, s)
        parts = self.cut.split(s)
        if len(parts) > 1 and all(self.derives(name, p) for p in parts if p):
            return True
        return self.derives(name, s)

    def check(self, text: str) -> None:
        s = self.reduced(self.lex(text))
        shape = ""
        for part in self.cut.split(s):
            if part:
                kind = next((k for name, k in self.kinds if self.derives(name, part)), None)
                if kind is None:
                    raise Rejected
                c = self.char(kind)
                if shape[-1:] != c or kind in ("PACKAGE", "MODULE"):
                    shape += c
        if not self.derives("Unit", shape):
            raise Rejected


class Java(Units):
    kinds = (("Package", "PACKAGE"), ("Import", "IMPORT"), ("Decl", "DECL"), ("Module", "MODULE"))
    lists = ("Stmts", "Members")

    def __post_init__(self) -> None:
        super().__post_init__()
        stay = "".join(re.escape(self.char(t)) for t in ". , ; : :: -> = + - * / % < > == != && || & | ^ ?".split()) + "".join(self.word(w) for w in ("else", "catch", "finally", "while", "instanceof"))
        self.cut = re.compile(f"(?<={self.char(';')})(?!{self.word('else')})|(?<={ANY_C})(?![{stay}]|[\ue000-\uefff])")

    def token(self, t: str) -> str:
        if t.startswith("//") or (t.startswith("/*") and len(t) > 3):
            return ""
        if t[0] == '"' and len(t) > 1:
            return self.char("STR")
        if t[0] == "'" and len(t) > 1:
            return self.char("CHAR")
        if t[0] == "$":
            return self.word("x")
        return super().token(t)


class Go(Units):
    kinds = (("Package", "PACKAGE"), ("Import", "IMPORT"), ("Decl", "DECL"))
    lists = ("Stmts",)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.auto = self.char(";", "AUTO")
        can_end = "".join([self.char("NUM"), self.char("STR"), self.char("CHAR"), re.escape(self.char("++")), re.escape(self.char("--")), r")\]}"] + [self.word(w) for w in ("break", "continue", "fallthrough", "return", "x")])
        self.no_end = re.compile(f"(?<![{can_end}]){self.auto}")
        self.cut = re.compile(f"(?<={self.auto})")

    def token(self, t: str) -> str:
        if t[0] == "\n":
            return self.auto
        if t.startswith("//"):
            return ""
        if t.startswith("/*") and len(t) > 3:
            return self.auto if "\n" in t else ""
        if t[0] in '"`' and len(t) > 1:
            return self.char("STR")
        if t[0] == "'" and len(t) > 1:
            return self.char("CHAR")
        return super().token(t)

    def lex(self, text: str) -> str:
        return self.no_end.sub("", super().lex(text + "\n"))

    def check(self, text: str) -> None:
        if "\x00" in text or "\ufeff" in text:
            raise Rejected
        super().check(text)


class Python(Parser):
    """Python 3: logical lines are parsed on their own, then the nesting of their kinds."""

    _HEADS = {"if": "If", "elif": "Elif", "else": "Else", "while": "While", "for": "For", "try": "Try", "except": "Except", "finally": "Finally", "with": "With", "def": "Def", "class": "Class"}
    _KIND = {"If": "IF", "Elif": "ELIF", "Else": "ELSE", "While": "WHILE", "For": "WHILE", "Try": "TRY", "Except": "EXCEPT", "Finally": "FINALLY", "With": "DEF", "Def": "DEF", "Class": "DEF", "Case": "CASE"}

    def __post_init__(self) -> None:
        super().__post_init__()
        self.heads = {self.word(w): (n,) for w, n in self._HEADS.items()}
        self.heads[self.word("async")] = ("Def", "For", "With")
        self.heads[self.char("@")] = ("Decorator",)
        self.heads[self.word("match")] = ("Match",)
        self.heads[self.word("case")] = ("Case",)
        self.colon = self.char(":")
        self.simple = self.char("SIMPLE")
        self.breaks = re.compile("\n.", re.S)
        self.blank = re.compile("(?:\n.)+(?=\n.)", re.S)
        self.bodies = re.compile("\x0e([^\x0e\x0f]*)\x0f")
        d, b = self.char("DEF"), self.char("BODY")
        self.again = re.compile(f"({self.simple})\\1+|((?:{d}{b}))\\2+")
        self.nesting: dict[str, str] = {}

    def token(self, t: str) -> str:
        c = t[0]
        if c in "\r\n":
            if "\n" not in t:
                return self.char("?")
            width = 0
            for x in t[t.index("\n") + 1 :]:
                width = 0 if x == "\f" else (width // 8 + 1) * 8 if x == "\t" else width + 1
            return "\n" + chr(0x4E00 + min(width, 20_000))
        if c == "#" or (c == "\\" and len(t) > 1):
            return ""
        if t[-1] in "\"'" and len(t) > 1:
            return self.char("STR")
        return super().token(t)

    def inside(self, letter: str, s: str) -> str:
        return self.breaks.sub("", s)

    def line(self, s: str) -> str:
        """The kind of a logical line, as a character; a class is nested like a function."""
        for name in self.heads.get(s[0], ()):
            if self.derives(name, s):
                if name == "Decorator":
                    return self.char("DECORATOR")
                if name == "Match":
                    return self.char("MATCH")
                return self.char(self._KIND[name] + ("" if s[-1] == self.colon else "1"))
        if self.derives("Simple", s):
            return self.simple
        raise Rejected

    def body(self, m: re.Match) -> str:
        s = self.again.sub(lambda x: x.group(1) or x.group(2), m.group(1))
        out = self.nesting.get(s)
        if out is None:
            names = [n for n, start in (("BODY", "Blocks"), ("CASES", "Cases")) if s and self.derives(start, s)]
            if not names:
                raise Rejected
            out = self.nesting[s] = self.char(*names)
        return out

    def check(self, text: str) -> None:
        if "\x00" in text:
            raise Rejected
        s = self.reduced(self.blank.sub("", self.lex("\n" + text)))
        levels, out = [0], []
        known = self.lines
        if len(known) > MOST_REMEMBERED:
            known.clear()
        for part in s.split("\n")[1:]:
            indent, shape = ord(part[0]) - 0x4E00, part[1:]
            if not shape:
                continue
            if indent > levels[-1]:
                levels.append(indent)
                out.append("\x0e")
            else:
                while indent < levels[-1]:
                    levels.pop()
                    out.append("\x0f")
                if indent != levels[-1]:
                    raise Rejected
            kind = known.get(shape)
            if kind is None:
                kind = known[shape] = self.line(shape)
            out.append(kind)
        s = "".join(out) + "\x0f" * (len(levels) - 1)
        n = 1
        while n:
            s, n = self.bodies.subn(self.body, s)
        s = self.again.sub(lambda x: x.group(1) or x.group(2), s)
        if "\x0e" in s or not self.derives("Blocks", s):
            raise Rejected


PARSERS = {"json": Json, "python": Python, "javascript": Ecma, "typescript": Ecma, "java": Java, "go": Go}
_made: dict[str, Parser] = {}


def parser(language: str) -> Parser:
    """The parser of a language; one for each worker process."""
    if language not in _made:
        _made[language] = PARSERS[language](language)
    return _made[language]


def is_valid(language: str, text: str) -> bool:
    """Whether ``text`` is syntactically valid in a supported language."""
    return parser(language).accepts(text)


def invalid_bodies(bodies: DataFrame) -> DataFrame:
    """The rows of (language, content_hash, content) whose body no dialect accepts, without the content.

    A null body or a language without a grammar is never a case. An empty body
    is valid except as JSON (and as Go, which needs a package clause).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [not is_valid(language, text) for language, text in zip(batch["language"], batch["content"], strict=True)]
            yield batch.loc[bad, ["language", "content_hash"]]

    known = bodies.where(F.col("language").isin(*PARSERS) & F.col("content").isNotNull())
    return known.select("language", "content_hash", "content").mapInPandas(run, "language string, content_hash string")
