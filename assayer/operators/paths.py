"""Paths, titles and other scalars of review data, and the scope of a pull request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.registry import Registry
from ..plans.views import table, view

REGISTRY = Registry()
#: The most directories a scope names, and what stands for more.
MOST_DIRS, FALLBACK = 20, "top20"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_LANGUAGE = "CASE " + " ".join(f"WHEN regexp_matches(path, '{_quoted(p)}') THEN '{n}'" for n, p in scalars.LANGUAGES.items()) + " END"
_NAME = "regexp_replace(path, '^.*/', '')"


@REGISTRY.query(
    f"SELECT key, regexp_matches(path, '{_quoted(scalars.NON_RUNTIME)}') AS non_runtime, {_LANGUAGE} AS language, CASE WHEN {_NAME} IN ({', '.join(repr(x) for x in scalars.LOCKFILES)}) THEN 'lockfile' "
    f"WHEN regexp_matches(path, '{scalars.POLICY}') THEN 'policy' WHEN regexp_matches(path, '{scalars.TEMPLATE}') THEN 'template' WHEN {_LANGUAGE} IS NOT NULL THEN 'code' END AS kind, len(string_split(path, '/')) AS depth FROM v_paths",
    "v_paths",
)
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path is outside the runtime, its language, its kind and how deep it lies."""
    path = F.col("path")
    shown = (path.rlike(scalars.NON_RUNTIME).alias("non_runtime"), scalars.language(path).alias("language"), scalars.source_kind(path).alias("kind"), F.size(F.split(path, "/")).alias("depth"))
    return view(spark, sf_dir, "v_paths").select("key", *shown)


@REGISTRY.query("SELECT key, lower(regexp_replace(replace(ident, '\"', ''), '^(?i:public\\.)', '')) AS ident FROM v_paths", "v_paths")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_paths").select("key", scalars.identifier(F.col("ident")).alias("ident"))


@REGISTRY.query(
    "SELECT key, '/' || array_to_string(list_filter(parts[root + 2:len(parts) - 1], lambda s: NOT starts_with(s, '(') AND NOT starts_with(s, '@')), '/') AS route, "
    "'/' || array_to_string(list_filter([regexp_replace('/api/', '^/+|/+$', '', 'g'), regexp_replace(path, '^/+|/+$', '', 'g'), ''], lambda s: s <> ''), '/') AS joined FROM "
    "(SELECT *, CASE WHEN a > 0 THEN f + a - 1 WHEN p > 0 THEN f + p - 1 ELSE -1 END AS root FROM (SELECT *, coalesce(list_position(parts[f + 1:], 'app'), 0) AS a, coalesce(list_position(parts[f + 1:], 'pages'), 0) AS p FROM "
    "(SELECT *, greatest(coalesce(list_position(parts, 'src'), 0) - 1, 0) AS f FROM (SELECT key, path, string_split(path, '/') AS parts FROM v_paths) x) y) z) w",
    "v_paths",
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of a file in an app directory, and its path joined below /api/."""
    joined = scalars.join_path(F.lit("/api/"), F.col("path"), F.lit("//"))
    return view(spark, sf_dir, "v_paths").select("key", scalars.app_route(F.col("path")).alias("route"), joined.alias("joined"))


_PLAIN = "regexp_replace(regexp_replace(CASE WHEN regexp_matches(path, '^\\([^/]*\\)') THEN path ELSE regexp_replace(path, '^\\(', '') END, '^\\./', ''), '^app/', '')"


@REGISTRY.query(f"SELECT key, plain, plain = 'f7.ts' OR ends_with(plain, '/f7.ts') AS same FROM (SELECT key, {_PLAIN} AS plain FROM v_paths) x", "v_paths")
def plain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited paths as they are compared, and whether they name the file app/f7.ts or f7.ts."""
    plain = view(spark, sf_dir, "v_paths").select("key", scalars.plain_path(F.col("path")).alias("plain"))
    return plain.select("key", "plain", scalars.same_path(F.col("plain"), F.lit("app/f7.ts")).alias("same"))


def scope_dirs(changed: DataFrame) -> DataFrame:
    """(scope, dir) of changed files (scope, path): their safe directories, without those below another one. Files at the root have none."""
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    dirs = changed.where(F.col("path").contains("/")).select("scope", scalars.safe_dir(parent).alias("dir")).where("dir <> '' AND dir <> '.security-audit' AND NOT startswith(dir, '.security-audit/')").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = dirs.select("scope", F.col("dir").alias("own"), F.explode(F.when(F.size(parts) > 1, above)).alias("dir")).join(dirs, ["scope", "dir"], "left_semi")
    return dirs.join(below.select("scope", F.col("own").alias("dir")).distinct(), ["scope", "dir"], "left_anti")


_DIRS = (
    ", s AS (SELECT key % 40 AS scope, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM v_paths WHERE contains(path, '/')), "
    "d AS (SELECT DISTINCT scope, array_to_string(CASE WHEN bad > 0 THEN parts[1:bad - 1] ELSE parts END, '/') AS dir FROM (SELECT *, coalesce(list_position(list_transform(parts, lambda x: NOT regexp_matches(x, "
    f"'{scalars.SAFE_SEGMENT}') OR x IN ('.', '..')), true), 0) AS bad FROM s) x), "
    "k AS (SELECT * FROM d WHERE dir <> '' AND NOT starts_with(dir || '/', '.security-audit/')), "
    "t AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.scope = k.scope AND p.dir <> k.dir AND starts_with(k.dir, p.dir || '/'))) "
)


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_paths").select((F.col("key") % 40).alias("scope"), "path")


@REGISTRY.query(_DIRS + "SELECT scope, dir FROM t", "v_paths")
def changed_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_dirs(_changed(spark, sf_dir))


def scope_value(changed: DataFrame, most: int = MOST_DIRS) -> DataFrame:
    """(scope, dirs, value) of every scope: its directories as a list, or the fallback for none and for more than most."""
    dirs = scope_dirs(changed).groupBy("scope").agg(F.count("*").alias("dirs"), F.array_sort(F.collect_list(F.concat("dir", F.lit("/")))).alias("named"))
    value = F.when(F.coalesce("dirs", F.lit(0)).between(1, most), F.array_join("named", ",")).otherwise(FALLBACK)
    return changed.select("scope").distinct().join(dirs, "scope", "left").select("scope", F.coalesce("dirs", F.lit(0)).alias("dirs"), value.alias("value"))


@REGISTRY.query(
    _DIRS + ", n AS (SELECT scope, count(*) AS dirs, string_agg(dir || '/', ',' ORDER BY dir || '/') AS value FROM t GROUP BY scope) "
    "SELECT a.scope, coalesce(dirs, 0) AS dirs, CASE WHEN coalesce(dirs, 0) BETWEEN 1 AND 6 THEN value ELSE 'top20' END AS value FROM (SELECT DISTINCT key % 40 AS scope FROM v_paths) a LEFT JOIN n ON n.scope = a.scope",
    "v_paths",
)
def pr_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of each of forty sets of changed files, for six directories at most."""
    return scope_value(_changed(spark, sf_dir), 6)


@REGISTRY.query(
    "SELECT conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, replace(text, '|', '\\|') AS cell, "
    "regexp_replace(text, '[<>`@\\[\\]]', '', 'g') AS plain FROM conversations"
)
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for HTML, for a cell of a Markdown table, and without what would mark it up."""
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.html(text).alias("html"), F.replace(text, F.lit("|"), F.lit("\\|")).alias("cell"), F.regexp_replace(text, r"[<>`@\[\]]", "").alias("plain"))


_MAPS = {"level": (scalars.LEVELS, "warning"), "security_severity": (scalars.SECURITY_SEVERITY, "5.5"), "linear": (scalars.LINEAR, "Medium"), "jira": (scalars.JIRA, "Medium")}


@REGISTRY.query("SELECT id, " + ", ".join(f"{scalars.case_sql(words, 'severity', other)} AS {name}" for name, (words, other) in _MAPS.items()) + " FROM v_findings", "v_findings")
def severity_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A severity as other tools call it."""
    return view(spark, sf_dir, "v_findings").select("id", *(scalars.looked_up(words, F.col("severity"), other).alias(name) for name, (words, other) in _MAPS.items()))


@REGISTRY.query(
    "SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN m < 60 THEN m || 'm ' || lpad(CAST(s % 60 AS STRING), 2, '0') || 's' ELSE (m // 60) || 'h ' || lpad(CAST(m % 60 AS STRING), 2, '0') || 'm' END AS shown FROM "
    "(SELECT event_id, s, s // 60 AS m FROM (SELECT event_id, CAST(floor((event_id * 7919 % 20000000) / 1000 + 0.5) AS BIGINT) AS s FROM events) x) y"
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("event_id") * 7919 % 20000000).cast("double")
    return table(spark, sf_dir, "events").select("event_id", scalars.duration(ms).alias("shown"))


@REGISTRY.query("SELECT file, count(*) AS entries, CASE WHEN count(*) < 20 THEN 'single' WHEN count(*) <= 50 THEN 'triage' ELSE 'parallel' END AS mode FROM (SELECT entry % 90 * (entry % 90) // 100 AS file FROM v_entries) x GROUP BY file", "v_entries")
def audit_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an audit runs, by its number of entry points."""
    project = F.expr("entry % 90 * (entry % 90) div 100").alias("file")
    counted = view(spark, sf_dir, "v_entries").select(project).groupBy("file").agg(F.count("*").alias("entries"))
    return counted.select("file", "entries", scalars.mode(F.col("entries")).alias("mode"))


_LINES = "CASE WHEN {0} % 5 = 0 THEN NULL ELSE {1} END"


@REGISTRY.query(
    "SELECT id, CASE WHEN a IS NULL AND c IS NULL THEN 0 WHEN a IS NULL OR c IS NULL THEN NULL WHEN b >= c AND d >= a THEN 0 WHEN b < c THEN c - b ELSE a - d END AS gap FROM "
    f"(SELECT id, {_LINES.format('id', 'start_line')} AS a, {_LINES.format('id', 'end_line')} AS b, {_LINES.format('run', 'category * 20')} AS c, {_LINES.format('run', 'category * 20 + 9')} AS d FROM v_findings) x",
    "v_findings",
)
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between two places, either of which may be unknown."""
    places = view(spark, sf_dir, "v_findings").selectExpr("id", *(f"{_LINES.format(*x)} AS {n}" for n, x in zip("abcd", (("id", "start_line"), ("id", "end_line"), ("run", "category * 20"), ("run", "category * 20 + 9")), strict=True)))
    return places.select("id", scalars.line_gap(*map(F.col, "abcd")).alias("gap"))


_TITLES = "concat('Fix `', {0}, '` in src/', {0}, '.ts:', CAST(p_size AS STRING), ' ', p_name, ' - ', {0})"
_PLAIN_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '`[^`]*`', ' ', 'g'), '[\\w./()\\[\\]@-]+\\.\\w+(:\\d+(\\s*[-–]\\s*\\d+)?)?', ' ', 'g'), '[^a-z]+', ' ', 'g'))"


@REGISTRY.query(f"SELECT p_partkey, {_PLAIN_TITLE.format(_TITLES.format('p_type'))} AS title FROM part")
def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without code and names of files."""
    return table(spark, sf_dir, "part").select("p_partkey", scalars.plain_title(F.expr(_TITLES.format("p_type"))).alias("title"))


@REGISTRY.query(
    "SELECT id, kind, category IS NULL OR any_category OR (category = 'dependency') = advisory AS fits FROM (SELECT id, kind, any_category, advisory, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'dependency' ELSE 'auth' END AS category FROM v_findings "
    "CROSS JOIN (VALUES ('plain', false, false), ('advisory', false, true), ('any', true, false)) k(kind, any_category, advisory)) x",
    "v_findings",
)
def category_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a finding of a category goes with each of the three kinds of entries of an answer key."""
    kinds = F.explode(F.expr("array(named_struct('kind', 'plain', 'any_category', false, 'advisory', false), named_struct('kind', 'advisory', 'any_category', false, 'advisory', true), named_struct('kind', 'any', 'any_category', true, 'advisory', false))")).alias("k")
    rows = view(spark, sf_dir, "v_findings").select("id", F.expr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'dependency' ELSE 'auth' END").alias("category"), kinds)
    return rows.select("id", "k.kind", scalars.compatible(F.col("category"), F.col("k.advisory"), F.col("k.any_category")).alias("fits"))


def lockfile_roots(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folders (dir) with root: the nearest folder, itself or above it, that holds a lock file of files (path); "" is the root of the tree, null where there is none.

    Each folder asks for all folders above it by equality, so as many rows move as folders are deep.
    """
    path = F.col("path")
    held = files.where(scalars.file_name(path).isin(scalars.LOCKFILES)).select(F.regexp_replace(path, r"/?[^/]*$", "").alias("root")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = folders.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "root"))
    nearest = asked.join(held, "root").groupBy("dir").agg(F.max_by("root", "depth").alias("root"))
    return folders.select("dir").distinct().join(nearest, "dir", "left").select("dir", "root")


_LOCKS = ", ".join(repr(x) for x in scalars.LOCKFILES)


@REGISTRY.query(
    f", d AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM v_paths), r AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS root FROM v_paths WHERE list_extract(string_split(path, '/'), -1) IN ({_LOCKS})) "
    "SELECT dir, arg_max(root, length(root)) AS root FROM d LEFT JOIN r ON root = '' OR root = dir OR starts_with(dir, root || '/') GROUP BY dir",
    "v_paths",
)
def nearest_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each folder the nearest one at or above it with a lock file."""
    files = view(spark, sf_dir, "v_paths").select("path")
    return lockfile_roots(files.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")), files)


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
