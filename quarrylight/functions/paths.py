"""Column rules over repository paths.

Every rule is a plain Column expression: it runs inside whole-stage code
generation and is pushed into the scan where Spark can. A null path gives a null
label or False; an empty path falls through to the last case of each cascade.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values: names that tell a file's category
IGNORED_DIRS = (
    "data cloned_repos testenv env .venv venv node_modules .git dist build .next __pycache__ .pytest_cache .cache .tox coverage out vendor target bin obj .turbo .output"
).split()
GENERATED_EXTENSIONS = ".min.js .min.css .map .pyc .pyo .pyd .so .dll .dylib .exe .bin .snap .lock".split()
GENERATED_NAMES = "package-lock.json pnpm-lock.yaml yarn.lock poetry.lock cargo.lock gemfile.lock composer.lock".split()
TEST_DIRS = "tests test __tests__ spec specs fixtures mocks test_utils".split()
TEST_SUFFIXES = "_test.py .test.ts .test.js .test.tsx .test.jsx .spec.ts .spec.js .spec.tsx .spec.jsx _spec.rb".split()
EXAMPLE_DIRS = "docs_src examples example samples sample demo demos tutorials tutorial cookbook benchmarks benchmark showcase".split()
DOCS_DIRS = "docs doc documentation site wiki mkdocs".split()
DOCS_EXTENSIONS = ".md .markdown .rst .adoc .txt".split()
DOCS_PREFIXES = "readme contributing changelog license architecture code_of_conduct authors security".split()
CONFIG_NAMES = (
    "pyproject.toml setup.py setup.cfg package.json tsconfig.json cargo.toml go.mod go.sum gemfile composer.json pom.xml build.gradle build.gradle.kts dockerfile "
    "docker-compose.yml docker-compose.yaml docker-compose.prod.yml makefile cmakelists.txt .env.example .flake8 .eslintrc .eslintrc.json .eslintrc.js .prettierrc"
).split()
LANGUAGE_OF = {
    "Python": ".py .pyi",
    "TypeScript": ".ts .tsx",
    "JavaScript": ".js .jsx .mjs .cjs",
    "Go": ".go",
    "Rust": ".rs",
    "Java": ".java",
    "Kotlin": ".kt .kts",
    "Swift": ".swift",
    "Ruby": ".rb",
    "PHP": ".php",
    "C#": ".cs",
    "C++": ".cpp .cc .cxx .hpp",
    "C": ".c .h",
    "Scala": ".scala",
    "Dart": ".dart",
    "Lua": ".lua",
    "R": ".r",
    "Shell": ".sh .bash .zsh",
    "SQL": ".sql",
    "HTML": ".html .htm",
    "CSS": ".css .scss .sass .less",
    "Markdown": ".md .markdown",
    "Documentation": ".rst",
    "JSON": ".json",
    "TOML": ".toml",
    "YAML": ".yaml .yml",
    "XML": ".xml",
}
SOURCE_PRIORITY = {"production": 1.0, "docs": 0.6, "example": 0.4, "test": 0.3, "config": 0.2, "generated": 0.0}
STACK_WEIGHT = {"production": 10.0, "config": 2.0, "example": 2.0, "test": 1.0, "docs": 0.1, "generated": 0.0}

#: fixed values: parts of a path that tell its layer, in the order they are tried
LAYERS = (
    ("Test", "test spec", ""),
    ("Configuration", "config setting", "pyproject.toml package.json tsconfig.json dockerfile .env"),
    ("Presentation", "component view page ui frontend/ router endpoint controller", ""),
    ("Infrastructure", "infra client adapter provider http sdk mcp", ""),
    ("Domain", "domain entity model types.ts schemas.py", ""),
    ("Data", "db database repo storage store schema", ""),
    ("Application", "service pipeline orchestrat usecase handler", ""),
    ("Shared", "util helper common shared", ""),
)
PRESENTATION_ENDINGS = ".tsx .jsx .astro".split()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words: str | list[str]) -> Column:
    return any_of([c.contains(w) for w in (words.split() if isinstance(words, str) else words)])


def ends_with_any(c: Column, endings: list[str]) -> Column:
    return any_of([c.endswith(e) for e in endings])


def clean(path: Column) -> Column:
    """Forward slashes, lower case, no leading slash or outer blanks."""
    return F.lower(F.regexp_replace(F.trim(F.translate(path, "\\", "/")), "^/+", ""))


def file_name(path: Column) -> Column:
    """the last path segment."""
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """everything before the last slash, empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot, empty if there is none; a leading dot begins none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def in_directory(path: Column, names: list[str]) -> Column:
    """Whether one of the folders of a path has one of the names."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))


def category(path: Column) -> Column:
    """Generated, example, test, config, docs or production, in this order of precedence."""
    p = clean(path)
    name, ext = file_name(p), extension(p)
    generated = in_directory(p, IGNORED_DIRS) | name.isin(GENERATED_NAMES) | ends_with_any(p, GENERATED_EXTENSIONS) | name.endswith("_pb2.py") | name.endswith("_pb2_grpc.py")
    test = in_directory(p, TEST_DIRS) | name.startswith("test_") | ends_with_any(name, TEST_SUFFIXES)
    docs = in_directory(p, DOCS_DIRS) | ext.isin(DOCS_EXTENSIONS) | ((ext == "") & any_of([name.startswith(x) for x in DOCS_PREFIXES]))
    return (
        F.when(p.isNull(), F.lit(None))
        .when(generated, "generated")
        .when(in_directory(p, EXAMPLE_DIRS), "example")
        .when(test, "test")
        .when(name.isin(CONFIG_NAMES) | name.startswith("requirements"), "config")
        .when(docs, "docs")
        .otherwise("production")
    )


def _choose(key: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def source_priority(label: Column) -> Column:
    """The retrieval weight of a category."""
    return _choose(label, SOURCE_PRIORITY)


def stack_weight(label: Column) -> Column:
    """The weight of a category when languages are counted."""
    return _choose(label, STACK_WEIGHT)


def language(path: Column) -> Column:
    """Language by extension, Unknown where there is none."""
    ext = extension(clean(path))
    out = F.when(ext.isNull(), F.lit(None))
    for name, endings in LANGUAGE_OF.items():
        out = out.when(ext.isin(endings.split()), name)
    return out.otherwise("Unknown")


def layer(path: Column) -> Column:
    """The architectural layer; parts are matched anywhere in the path, in order."""
    p = F.lower(F.translate(path, "\\", "/"))
    out = F.when(p.isNull(), F.lit(None))
    for label, words, names in LAYERS:
        hit = contains_any(p, words)
        if names:
            hit = hit | file_name(p).isin(names.split())
        if label == "Presentation":
            hit = hit | ends_with_any(p, PRESENTATION_ENDINGS)
        out = out.when(hit, label)
    return out.otherwise("Domain")


#: fixed values: words in path or text that tell a design pattern (pattern, in path, in text)
PATTERNS = (
    ("Adapter", "adapter", "adapter"),
    ("Builder", "builder", "builder"),
    ("Command", "command", "command execut"),
    ("Dependency Injection", "provider dependencies.py", "inject"),
    ("Event Driven", "event", "listener subscriber emitter"),
    ("Facade", "facade manager orchestrat", ""),
    ("Factory", "factory", "factory create_"),
    ("MVC", "controller model view", ""),
    ("Middleware", "middleware", "middleware"),
    ("Observer", "event", "listener subscriber emitter"),
    ("Pipeline", "pipeline", "pipeline"),
    ("Repository Pattern", "repository repo", "repository"),
    ("Singleton", "", "singleton _instance get_instance"),
    ("Strategy", "strategy policy", ""),
)


def design_patterns(path: Column, text: Column) -> Column:
    """The patterns whose words stand in path or text, sorted; Facade where there are none."""
    p, t = F.lower(F.translate(path, "\\", "/")), F.lower(F.coalesce(text, F.lit("")))
    tags = []
    for name, in_path, in_text in PATTERNS:
        hits = ([contains_any(p, in_path)] if in_path else []) + ([contains_any(t, in_text)] if in_text else [])
        tags.append(F.when(any_of(hits), F.lit(name)))
    clean_code = p.contains("domain") & p.contains("infrastructure")
    tags += [F.when(clean_code, F.lit("Clean Architecture")), F.when(clean_code, F.lit("Hexagonal"))]
    found = F.array_sort(F.array_compact(F.array(*tags)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Facade")))


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs, without case.

    ``name/`` matches any path part, other globs the whole path or its last part.
    Globs become regular expressions when the plan is built.
    """
    p = F.lower(F.translate(path, "\\", "/"))
    out = F.lit(False)
    for glob in patterns:
        g = glob.replace("\\", "/").lower()
        if g.endswith("/"):
            out = out | F.array_contains(F.split(p, "/"), g[:-1])
        r = glob_regex(g)
        out = out | p.rlike(r) | file_name(p).rlike(r)
    return F.coalesce(out, F.lit(False))


def glob_regex(glob: str) -> str:
    """A glob of *, ? and [...] as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/" else c
        i += 1
    return f"^{out}$"


def module_of(path: Column) -> Column:
    """a file path as a dotted module, without extension and package marker."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"\.[^./]+$", "")
    return F.regexp_replace(F.translate(p, "/", "."), r"\.__init__$", "")


def module_path(module: Column) -> Column:
    """a dotted module as a path."""
    return F.translate(module, ".", "/")


def is_test_path(path: Column) -> Column:
    """P10, F04."""
    return F.coalesce(category(path) == "test", F.lit(False))


def is_generated_path(path: Column) -> Column:
    """P10."""
    return F.coalesce(category(path) == "generated", F.lit(False))


def is_valid_relative(path: Column) -> Column:
    """a repository-relative path with forward slashes and no empty, dot or parent part."""
    bad = path.rlike(r"^/|\\|//|/$|(^|/)\.{1,2}(/|$)|\x00") | (path == "")
    return F.coalesce(~bad, F.lit(False))


#: fixed values: components by words in a path
COMPONENTS = {
    "Authentication": r"auth|oauth|login|token|jwt|session",
    "API Layer": r"api|route|endpoint|controller|view",
    "Database": r"db|database|model|migration|schema|orm|sql|chroma|sqlite",
    "Frontend": r"front|ui|component|page|template|html|css|tsx|jsx",
    "Services": r"service|retriev|embed|chunk|github|mcp",
    "Models": r"model|schema|pydantic|dataclass",
    "Agents": r"agent|evaluat|explainer|analyzer|mapper",
    "Memory": r"memory|cache|store|chroma",
    "Tests": r"test|spec|fixture|mock",
}


def components(path: Column) -> Column:
    """Every component whose pattern a path matches, sorted."""
    p = F.lower(path)
    return F.array_sort(F.array_compact(F.array(*[F.when(p.rlike(r), F.lit(k)) for k, r in COMPONENTS.items()])))


def basic_layer_violation(source: Column, target: Column) -> Column:
    """The broken layer rules of a dependency between two labels or paths, as an array of rule ids."""
    a, b, t = layer(source), layer(target), F.lower(target)
    return F.array_compact(
        F.array(
            F.when((a == "Domain") & b.isin("Presentation", "Infrastructure"), F.lit("ARCH-001")),
            F.when((a == "Presentation") & (b.isin("Data", "Infrastructure") | t.contains("db") | t.contains("repository")), F.lit("ARCH-002")),
            F.when((a == "Infrastructure") & (b == "Presentation"), F.lit("ARCH-003")),
        )
    )


SEVERITY_OF_RULE = {"ARCH-001": "CRITICAL", "ARCH-002": "MAJOR", "ARCH-003": "CRITICAL"}
