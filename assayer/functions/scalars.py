"""Scalar rules of review data as columns: paths, severities, places and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of paths, words of severities and their maps.
NON_RUNTIME = (
    r"(^|/)(__tests__|tests?|e2e|migrations?|drizzle|seeds?|fixtures)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)seed[^/]*$"
    r"|(^|/)(?:test_[^/]*|[^/]*_test|conftest)\.py$|_test\.go$|(^|/)testdata/"
)
LANGUAGES = {
    "js": r"\.[cm]?jsx?$", "ts": r"\.[cm]?tsx?$", "php": r"\.(?:php|module|inc|theme|install)$", "python": r"\.py$",
    "go": r"\.go$", "ruby": r"\.rb$", "rust": r"\.rs$", "java": r"\.(?:java|kt)$",
}
POLICY = r"(^|/)supabase/(?:migrations/[^/]+\.sql|config\.toml)$|(^|/)(?:firestore|storage)\.rules$"
TEMPLATE = r"\.twig$|(^|/)templates/.+\.html?$"
LOCKFILES = [
    "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lock", "composer.lock", "poetry.lock",
    "uv.lock", "requirements.txt", "Pipfile.lock", "go.sum", "Cargo.lock", "Gemfile.lock",
]
SEVERITY_WORDS = {"critical": "critical", "error": "high", "high": "high", "warning": "medium", "medium": "medium", "low": "low"}
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
SECURITY_SEVERITY = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0"}
LINEAR = {"CRITICAL": "Urgent", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low"}
JIRA = {"CRITICAL": "Highest", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low"}
SAFE_SEGMENT = r"^[A-Za-z0-9_.][A-Za-z0-9_.-]*$"
MOUNT = "/src/"
#: Names of files within titles.
FILE_NAMES = r"[\w./()\[\]@-]+\.\w+(:\d+(\s*[-–]\s*\d+)?)?"


def looked_up(words: dict[str, str], key: Column, other: str) -> Column:
    """The word for key, or other. Null and unknown keys have none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[key], F.lit(other))


def case_sql(words: dict[str, str], key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE '{other}' END"


def severity(word: Column) -> Column:
    """A scanner's word for a severity as one of critical, high, medium, low and info; null is info."""
    return looked_up(SEVERITY_WORDS, F.lower(F.coalesce(word, F.lit(""))), "info")


def tool_path(path: Column, root: str) -> Column:
    """A scanner's path relative to the project, whether it is absolute, under the container's mount or begins with ./ or file://."""
    text = F.regexp_replace(F.coalesce(path, F.lit("")), r"^file://", "")
    prefix = root.rstrip("/") + "/"
    text = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, f"^{MOUNT}", ""), r"^\./", "")


def note(text: Column) -> Column:
    """At most 140 letters, with single spaces for white space and apostrophes for backticks."""
    return F.substring(F.trim(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), "`", "'")), 1, 140)


def language(path: Column) -> Column:
    """The first language whose extension fits; null if none does."""
    return F.coalesce(*(F.when(path.rlike(p), F.lit(name)) for name, p in LANGUAGES.items()))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_kind(path: Column) -> Column:
    """lockfile, policy, template or code; null for other files."""
    return (
        F.when(file_name(path).isin(LOCKFILES), "lockfile").when(path.rlike(POLICY), "policy").when(path.rlike(TEMPLATE), "template").when(language(path).isNotNull(), "code")
    )


def identifier(name: Column) -> Column:
    """An SQL name without quotes and without public., in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, '"', ""), r"^(?i:public\.)", ""))


def app_route(path: Column) -> Column:
    """The route of a file below app or pages (after src, if there is one): groups in brackets and slots don't count."""
    parts = F.split(path, "/")
    start = F.greatest(F.array_position(parts, "src") - 1, F.lit(0))
    tail = F.slice(parts, (start + 1).cast("int"), F.size(parts))
    app, pages = F.array_position(tail, "app"), F.array_position(tail, "pages")
    root = F.when(app > 0, start + app - 1).when(pages > 0, start + pages - 1).otherwise(-1)
    inner = F.slice(parts, (root + 2).cast("int"), F.greatest(F.size(parts) - root - 2, F.lit(0)).cast("int"))
    return F.concat(F.lit("/"), F.array_join(F.filter(inner, lambda s: ~s.startswith("(") & ~s.startswith("@")), "/"))


def join_path(*parts: Column) -> Column:
    """Parts with one slash before each, without those at their own ends; empty ones don't count."""
    trimmed = F.transform(F.array(*parts), lambda p: F.regexp_replace(p, r"^/+|/+$", ""))
    return F.concat(F.lit("/"), F.array_join(F.filter(trimmed, lambda p: p != ""), "/"))


def plain_path(path: Column) -> Column:
    """A cited path without an opening bracket that isn't closed in its first part, ./ and app/."""
    bare = F.when(path.rlike(r"^\([^/]*\)"), path).otherwise(F.regexp_replace(path, r"^\(", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), r"^app/", "")


def same_path(cited: Column, file: Column) -> Column:
    """Whether a cited path is the file or ends with it, with or without the file's own app/."""
    short = plain_path(file)
    return (cited == file) | cited.endswith(F.concat(F.lit("/"), file)) | (cited == short) | cited.endswith(F.concat(F.lit("/"), short))


def safe_dir(directory: Column) -> Column:
    """The part of a directory before its first segment that is unsafe for a command line."""
    parts = F.split(directory, "/")
    unsafe = F.transform(parts, lambda s: ~s.rlike(SAFE_SEGMENT) | s.isin(".", ".."))
    first = F.array_position(unsafe, True).cast("int")
    return F.array_join(F.when(first > 0, F.slice(parts, F.lit(1), first - 1)).otherwise(parts), "/")


def duration(ms: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes. Halves are rounded up."""
    s = F.floor(ms / 1000 + 0.5)
    m = F.floor(s / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), two(m % 60), F.lit("m")))
    )


def mode(entries: Column) -> Column:
    """How an audit of so many entry points runs."""
    return F.when(entries < 20, "single").when(entries <= 50, "triage").otherwise("parallel")


def line_gap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Lines between [a, b] and [c, d]: 0 if they meet or neither is known, null if one is not."""
    return F.when(a.isNull() & c.isNull(), 0).when(a.isNull() | c.isNull(), F.lit(None).cast("int")).otherwise(F.greatest(F.lit(0), c - b, a - d))


def compatible(category: Column, advisory: Column, any_category: Column) -> Column:
    """Dependency findings go with advisories and others with the rest; no category and entries for any go with all."""
    return category.isNull() | F.coalesce(any_category, F.lit(False)) | ((category == "dependency") == F.coalesce(advisory, F.lit(False)))


def plain_title(title: Column) -> Column:
    """Letters of a title in lower case, without code and names of files."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"`[^`]*`", " "), FILE_NAMES, " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z]+", " "))


def same_title(a: Column, b: Column) -> Column:
    """Equal titles, or 0.6 of the words of both shared. Titles without letters are like none."""
    x, y = plain_title(a), plain_title(b)
    v, w = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    return (x != "") & (y != "") & ((x == y) | (F.size(F.array_intersect(v, w)) / F.size(F.array_union(v, w)) >= 0.6))


def csv_cell(value: Column) -> Column:
    """A quoted cell that no spreadsheet takes for a formula; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def html(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def section(body: Column, name: str) -> Column:
    """What stands under a heading of Markdown until the next one, trimmed; null without the heading."""
    found = F.regexp_extract(body, rf"(?m)^##\s+{name}\s*\n([\s\S]*?)(?=^##\s|\z)", 1)
    return F.when(body.rlike(rf"(?m)^##\s+{name}\s*\n"), F.trim(F.regexp_replace(found, r"^\s+|\s+\z", "")))
