"""Scalar expressions over paths, blobs, comments and names; all of them run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of paths that are left out unless others are named.
BLACKLIST = ("vendor/", "vendors/", "package-lock.json", "Gopkg.lock")
LANGUAGES = {"py": "Python", "go": "Go", "java": "Java", "js": "JavaScript", "ts": "TypeScript", "rb": "Ruby", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++", "cs": "C#", "rs": "Rust", "php": "PHP", "scala": "Scala", "kt": "Kotlin", "sh": "Shell", "md": "Markdown", "json": "JSON", "yml": "YAML", "yaml": "YAML", "html": "HTML", "css": "CSS", "sql": "SQL", "proto": "Protocol Buffer"}
IMPORTS = {"Python": r"(?m)^\s*(?:import|from)\s+([\w.]+)", "Go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "Java": r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "JavaScript": r"(?:from|require\(|import)\s*['\"]([^'\"]+)['\"]", "C": r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "C++": r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "Ruby": r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "Rust": r"(?m)^\s*use\s+([\w:]+)"}


def is_binary(data: str | Column) -> Column:
    """A NUL among the first 8000 bytes."""
    return F.locate("\0", F.substring(F.encode(data, "UTF-8"), 1, 8000).cast("string")) > 0


def line_count(data: str) -> Column:
    """Lines of a text, a last one without an end counted too; null if it is binary."""
    text = F.col(data)
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(~is_binary(text), F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))).cast("bigint")


def basename(path: str) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def blacklisted(*paths: str, prefixes: tuple[str, ...] = BLACKLIST) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(p).startswith(x), F.lit(False)) for p in paths for x in prefixes])


#: Paths of what others wrote or tools made.
VENDORED = r"(^|/)(vendors?|node_modules|bower_components|third[-_]?party|3rd[-_]?party|externals?|Godeps|Pods|Carthage|dist|cache|deps|\.git|\.idea|\.vscode|__pycache__)/|[.-]min\.(js|css)$|(^|/)(jquery|bootstrap|react|angular)([.-][^/]*)?\.(js|css)$|(^|/)(package-lock\.json|yarn\.lock|Gopkg\.lock|go\.sum|Cargo\.lock|Gemfile\.lock|gradlew(\.bat)?|mvnw(\.cmd)?|configure|config\.(guess|sub)|aclocal\.m4)$"


def vendored(path: str) -> Column:
    """Whether a path is of vendored code, a lock file or what a build tool leaves."""
    return F.coalesce(F.rlike(path, F.lit(VENDORED)), F.lit(False))


def whitelisted(*paths: str, pattern: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.rlike(p, F.lit(pattern)), F.lit(False)) for p in paths])


#: Files that are known by their whole name, and interpreters of scripts.
NAMES = {"makefile": "Makefile", "dockerfile": "Dockerfile", "cmakelists.txt": "CMake", "rakefile": "Ruby", "gemfile": "Ruby", "jenkinsfile": "Groovy", "build.bazel": "Starlark"}
INTERPRETERS = {"python": "Python", "python2": "Python", "python3": "Python", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "node": "JavaScript", "ruby": "Ruby", "perl": "Perl", "php": "PHP"}


def _found(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language(path: str, data: str | None = None) -> Column:
    """The language that goes by a file's name, its ending or, where data is given, the interpreter that its first line names;
    '' if unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = [_found(NAMES, F.lower(basename(path))), _found(LANGUAGES, ending)]
    if data is not None:
        known.append(_found(INTERPRETERS, F.regexp_extract(data, r"^#!\s*(?:\S*/env\s+(?:-\S+\s+)*|\S*/)?([a-z]+[0-9]?)", 1)))
    return F.coalesce(*known, F.lit(""))


def imports(lang: str, data: str) -> Column:
    """The list of what a source file imports."""
    found = None
    for name, pattern in IMPORTS.items():
        one = F.regexp_extract_all(data, F.lit(pattern), F.lit(1))
        found = F.when(F.col(lang) == name, one) if found is None else found.when(F.col(lang) == name, one)
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def clean_comment(text: str, least: int = 20) -> Column:
    """A comment without calls and signs, blanks run together; null if it is short, not a sentence, or legal text.

    Each step is computed once, as the element of a list of one or none: column expressions that are named twice would be
    copied into every place of the plan. What begins wrong or is too short to end long enough isn't cleaned at all.
    """
    size = max(least, 10)
    some = F.filter(F.array(F.trim(F.col(text))), lambda t: (F.length(t) >= size) & F.rlike(t, F.lit(r"^[\p{L}\p{N}]")))
    calls = F.transform(some, lambda t: F.regexp_replace(t, r"\s*[a-zA-Z_][a-zA-Z_0-9]*\(\)", " "))
    one = F.transform(calls, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}.,:;!?\-'\s]", ""), r"\s+", " ")))
    long = F.filter(one, lambda t: (F.length(t) >= size) & ~is_license(t) & (F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) * 10 >= F.length(t) * 6))
    return F.get(long, F.lit(0))


def is_license(text: str | Column) -> Column:
    return F.rlike(F.lower(text), F.lit("license|copyright|©"))


def yaml_quoted(text: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def printable(text: str) -> Column:
    """text without the characters that YAML has no place for."""
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x7E\x85\x{A0}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def short_number(value: str) -> Column:
    v = F.col(value)
    return F.when(v >= 1_000_000, F.concat(F.floor(v / 1_000_000).cast("string"), F.lit("M"))).when(v >= 1000, F.concat(F.floor(v / 1000).cast("string"), F.lit("K"))).otherwise(v.cast("string"))


def mailmap(line: str) -> Column:
    """(name, email, old_name, old_email) of a line 'Name <mail> Old <old mail>'; null if it doesn't end in a mail address."""
    parts = [F.trim(F.regexp_extract(line, r"^([^<]*)<([^>]+)>\s*(?:([^<]*)<([^>]+)>)?\s*$", k)) for k in range(1, 5)]
    names = ("name", "email", "old_name", "old_email")
    return F.when(parts[1] != "", F.struct(*[F.nullif(p, F.lit("")).alias(n) for p, n in zip(parts, names)]))
