"""Facts out of source files: symbols, imports, calls, exports and line chunks.

Python is read by its own syntax tree, other languages by conservative patterns.
A file that does not parse gives one ``error`` row and never an exception. Files
are independent, so the plan has no shuffle; the parser of a language is looked
up in a registry that can be added to.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "g string, path string, fact string, kind string, name string, parent string, start int, end int, detail string"
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
Fact = tuple[str, str | None, str | None, str | None, int, int, str | None]  # fact, kind, name, parent, start, end, detail


def python_facts(text: str) -> Iterator[Fact]:
    """Symbols with parent and parameters, imports with alias and level, calls with receiver, bases.

    J11: types of arguments by annotation and of variables by the call assigned to them.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.removeprefix("\ufeff"))

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        if isinstance(node, ast.Call):
            return dotted(node.func)
        return None

    def walk(node: ast.AST, parents: tuple[str, ...], in_class: bool) -> Iterator[Fact]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                params = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]] + [x.arg for x in (a.vararg, a.kwarg) if x]
                kind = "method" if in_class else "function"
                yield "symbol", kind, child.name, ".".join(parents) or None, child.lineno, child.end_lineno or child.lineno, ",".join(params)
                for d in child.decorator_list:
                    yield "decorator", kind, child.name, ".".join(parents) or None, d.lineno, d.lineno, dotted(d)
                for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
                    if x.annotation is not None and (t := dotted(x.annotation)):
                        yield "type", "argument", x.arg, ".".join([*parents, child.name]), child.lineno, child.lineno, t
                yield from walk(child, (*parents, child.name), False)
            elif isinstance(child, ast.ClassDef):
                yield "symbol", "class", child.name, ".".join(parents) or None, child.lineno, child.end_lineno or child.lineno, ""
                for b in child.bases:
                    if name := dotted(b):
                        yield "base", "class", child.name, ".".join(parents) or None, b.lineno, b.lineno, name
                yield from walk(child, (*parents, child.name), True)
            else:
                if isinstance(child, ast.Import):
                    for n in child.names:
                        yield "import", "module", n.asname or n.name, ".".join(parents) or None, child.lineno, child.lineno, n.name
                elif isinstance(child, ast.ImportFrom):
                    for n in child.names:
                        yield "import", "symbol", n.asname or n.name, ".".join(parents) or None, child.lineno, child.lineno, "." * child.level + (child.module or "") + ":" + n.name
                elif isinstance(child, ast.Call):
                    if name := dotted(child.func):
                        head, _, tail = name.rpartition(".")
                        yield "call", "call", tail, ".".join(parents) or None, child.lineno, child.lineno, head
                elif isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and len(child.targets) == 1 and isinstance(child.targets[0], ast.Name):
                    if t := dotted(child.value.func):
                        yield "type", "assigned", child.targets[0].id, ".".join(parents), child.lineno, child.lineno, t
                yield from walk(child, parents, in_class and not isinstance(child, ast.Lambda))

    yield from walk(tree, (), False)


_JS_SYMBOL = re.compile(
    r"^[ \t]*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(async\s+)?function\*?\s+(?P<function>[\w$]+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)|class\s+(?P<class>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?|interface\s+(?P<interface>[\w$]+)|enum\s+(?P<enum>[\w$]+)"
    r"|(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*=\s*(?:async\s*)?(?:\((?P<aparams>[^)]*)\)|[\w$]+)\s*=>)",
    re.M,
)
_JS_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<named>[^}]*)\}|\*\s+as\s+(?P<space>[\w$]+))?\s*from\s*['\"](?P<path>[^'\"]+)['\"]|(?:const|let|var)\s+(?:(?P<req>[\w$]+)|\{(?P<reqn>[^}]*)\})\s*=\s*require\(['\"](?P<rpath>[^'\"]+)['\"]\)")
_CALL = re.compile(r"(?<![\w$.])(?:(?P<receiver>[\w$]+(?:\.[\w$]+)*)\.)?(?P<name>[\w$]+)\s*\(")
_NO_CALL = frozenset("if for while switch catch function return typeof new await super import constructor throw do else case in of with yield delete void instanceof".split())
_NOISE = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def script_facts(text: str) -> Iterator[Fact]:
    """The same for JavaScript and TypeScript, by patterns; the end of a symbol is where its braces close."""
    bare = _NOISE.sub(_blank, text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(at: int) -> int:
        low, high = 0, len(starts)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if starts[mid] <= at else (low, mid)
        return low + 1

    def closing(at: int) -> int:
        depth, seen = 0, False
        for m in re.compile(r"[{}\n;]").finditer(bare, at):
            if m.group() == "{":
                depth, seen = depth + 1, True
            elif m.group() == "}":
                depth -= 1
                if seen and depth <= 0:
                    return line(m.start())
            elif not seen and m.group() == ";":
                return line(m.start())
        return line(len(text))

    for m in _JS_SYMBOL.finditer(bare):
        kind = next(k for k in ("function", "class", "interface", "enum", "arrow") if m.group(k))
        name, params = m.group(kind), m.group("params") or m.group("aparams") or ""
        first = line(m.start() + len(m.group()) - len(m.group().lstrip()))
        yield "symbol", "function" if kind == "arrow" else kind, name, None, first, closing(m.end()), ",".join(p.split(":")[0].split("=")[0].strip(" .?") for p in params.split(",") if p.strip())
        if m.group(1):
            yield "export", kind, name, None, first, first, None
        if m.group("base"):
            yield "base", "class", name, None, first, first, m.group("base")
    for m in _JS_IMPORT.finditer(text):
        at, path = line(m.start()), m.group("path") or m.group("rpath")
        if m.group("default") or m.group("req"):
            yield "import", "module", m.group("default") or m.group("req"), None, at, at, path
        if m.group("space"):
            yield "import", "module", m.group("space"), None, at, at, path
        for item in (m.group("named") or m.group("reqn") or "").split(","):
            parts = re.split(r"\s+as\s+|\s*:\s*", item.strip())
            if parts[0]:
                yield "import", "symbol", parts[-1], None, at, at, f"{path}:{parts[0]}"
    for m in _CALL.finditer(bare):
        if m.group("name") not in _NO_CALL and not re.search(r"\bfunction\*?\s+$", bare[max(0, m.start() - 14) : m.start()]):
            at = line(m.start())
            yield "call", "call", m.group("name"), None, at, at, m.group("receiver") or ""


#: The parser of each language; add to it with :func:`register_parser`.
PARSERS: dict[str, Callable[[str], Iterator[Fact]]] = {"python": python_facts, "javascript": script_facts, "typescript": script_facts}


def register_parser(language: str, parser: Callable[[str], Iterator[Fact]]) -> None:
    """Add or replace the parser of a language."""
    PARSERS[language] = parser


def extract_facts(files: DataFrame) -> DataFrame:
    """Facts of files (g, path, language, content); see :data:`FACTS`.

    Languages without a parser and null contents give no rows; further columns are not read.
    """
    parsers = dict(PARSERS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, path, language, content in batch.itertuples(index=False):
                try:
                    out += [(g, path, *f) for f in parsers[language](content)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((g, path, "error", type(e).__name__, None, None, getattr(e, "lineno", None) or 0, 0, str(e)[:200]))
            yield pd.DataFrame(out, columns=_COLUMNS)

    known = files.where(F.col("language").isin(*parsers) & F.col("content").isNotNull())
    return known.select("g", "path", "language", "content").mapInPandas(parse, FACTS)


def line_chunks(files: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(g, path, chunk_id, start_line, end_line, content): windows of whole lines.

    At most ``size`` characters and up to ``overlap`` characters of whole closing
    lines of the chunk before; a longer line is a chunk of its own; blank chunks
    are left out and ids count from 1.
    """

    def chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
        first, used = 0, 0
        for i, s in enumerate(lines):
            n = len(s) + 1
            if n > size:
                if i > first:
                    yield first, i
                yield i, i + 1
                first, used = i + 1, 0
                continue
            if used + n > size:
                yield first, i
                back, room = i, overlap
                while back > first and len(lines[back - 1]) + 1 <= room and (i - back + 1) < i - first + 1:
                    back -= 1
                    room -= len(lines[back]) + 1
                first, used = back, sum(len(x) + 1 for x in lines[back:i])
                if used + n > size:
                    first, used = i, 0
            used += n
        if first < len(lines):
            yield first, len(lines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, path, content in batch.itertuples(index=False):
                lines, k = content.splitlines(), 0
                for a, b in chunks(lines):
                    body = "\n".join(lines[a:b])
                    if body.strip():
                        k += 1
                        out.append((g, path, k, a + 1, b, body))
            yield pd.DataFrame(out, columns=["g", "path", "chunk_id", "start_line", "end_line", "content"])

    return files.select("g", "path", "content").where("content is not null").mapInPandas(run, "g string, path string, chunk_id int, start_line int, end_line int, content string")
