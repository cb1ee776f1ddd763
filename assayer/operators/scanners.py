"""Scanner reports read back: the hits of a table are written as each scanner writes them, and parsed into rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.checkpoints import checkpointed
from ..plans.ordering import in_blocks, ranked
from ..plans.views import view, with_views
from ..sources import reports

# What each scanner says of a hit, as Spark SQL over v_hits, and the shape of its document around the list of them.
WRITTEN = {
    "semgrep": ("named_struct('path', path, 'start', named_struct('line', line), 'check_id', rule, 'extra', named_struct('severity', level, 'message', message))", '{{"results":{}}}'),
    "bandit": ("named_struct('filename', path, 'line_number', line, 'test_id', rule, 'test_name', extra, 'issue_severity', level, 'issue_text', message, 'issue_confidence', upper(level))", '{{"results":{}}}'),
    "gosec": ("named_struct('file', path, 'line', concat(line, '-', line + 2), 'rule_id', rule, 'cwe', named_struct('id', extra), 'severity', level, 'details', message)", '{{"Issues":{}}}'),
    "sarif": (
        "named_struct('ruleId', rule, 'level', lower(level), 'message', named_struct('text', message), 'locations', array(named_struct('physicalLocation', "
        "named_struct('artifactLocation', named_struct('uri', path), 'region', named_struct('startLine', line)))))", '{{"runs":[{{"results":{}}},{{"results":[]}}]}}'),
    "hadolint": ("named_struct('file', path, 'line', line, 'code', rule, 'level', level, 'message', message)", "{}"),
}


def documents(hits: DataFrame, element: str, shape: str) -> DataFrame:
    """(report, text): a report's hits as documents of the shape, one a block of rows, so that a document stays small however many hits a report has."""
    before, after = shape.format("\0").split("\0")
    # within an aggregate an element would be made by an interpreter, before it by compiled code; as text it is cheap to sort and move
    rows = in_blocks(hits).select("report", "_block", F.to_json(F.array(F.expr(element))).alias("element"))
    listed = F.array_join(F.collect_list(F.substring("element", F.lit(2), F.length("element") - 2)), ",")
    return rows.groupBy("report", "_block").agg(F.concat(F.lit(before + "["), listed, F.lit("]" + after)).alias("text")).drop("_block")


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(reports, name)(documents(view(spark, sf_dir, "v_hits"), *WRITTEN[name]))

    query.__name__ = f"parse_{name}"
    query.__doc__ = f"Rows of {name} reports, several hits to a report."
    return query


def parse_trivy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of trivy reports: a target for each hit, with a check that failed, one that passed and one without status or title."""
    check = "named_struct('Status', s, 'CauseMetadata', named_struct('StartLine', line), 'ID', nullif(rule, 'r3'), 'AVDID', 'AVD', 'Severity', level, 'Title', if(s = 'FAIL', message, ''), 'Message', 'plain')"
    target = "named_struct('Target', path, 'Misconfigurations', transform(array('FAIL', 'PASS', cast(null as string)), s -> " + check + "))"
    return reports.trivy(documents(view(spark, sf_dir, "v_hits"), target, '{{"Results":{}}}'))


def parse_govulncheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of message streams, one a report and block: an advisory of each rule and a finding of each hit, called, imported or required."""
    hits = in_blocks(view(spark, sf_dir, "v_hits"))
    frames = (
        "CASE ord % 3 WHEN 0 THEN array(named_struct('module', 'm', 'version', 'v1', 'package', 'm/p', 'function', 'F', 'position', cast(null as struct<filename: string, line: int>)), "
        "named_struct('module', 'a', 'version', 'v0', 'package', 'a', 'function', 'G', 'position', named_struct('filename', path, 'line', cast(line as int)))) "
        "WHEN 1 THEN array(named_struct('module', 'm', 'version', 'v1', 'package', 'm/p', 'function', cast(null as string), 'position', cast(null as struct<filename: string, line: int>))) "
        "ELSE array(named_struct('module', 'm', 'version', cast(null as string), 'package', cast(null as string), 'function', cast(null as string), 'position', cast(null as struct<filename: string, line: int>))) END"
    )
    found = F.expr(f"to_json(named_struct('finding', named_struct('osv', rule, 'fixed_version', extra, 'trace', {frames})))")
    stream = hits.groupBy("report", "_block").agg(
        F.array_join(F.collect_list(found), "\n").alias("found"),
        F.array_join(F.collect_set(F.when(F.col("rule") != "r1", F.expr("to_json(named_struct('osv', named_struct('id', rule, 'summary', concat('about ', rule, ' {'))))"))), "").alias("osv"),
    )
    return reports.govulncheck(stream.select("report", F.concat(F.lit('{"config":{}}'), "found", "osv").alias("text")))


def severity_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised severity, path and note of each hit."""
    shown = (scalars.severity(F.col("level")).alias("severity"), scalars.tool_path(F.col("path"), reports.ROOT).alias("file"), scalars.note(F.col("message")).alias("note"))
    return view(spark, sf_dir, "v_hits").select("ord", *shown)


def advisory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of advisory reports: the highest score, the first CVE of each group and at most four versions that fix them."""
    rows = view(spark, sf_dir, "v_hits").where("line IS NOT NULL")
    groups = "array(named_struct('ids', array(concat('GHSA-', line), concat('CVE-', line)), 'max_severity', concat(line, '.5')), named_struct('ids', array(concat('GHSA-', rule)), 'max_severity', ''))"
    events = "array(named_struct('events', array(named_struct('fixed', cast(null as string)), named_struct('fixed', concat('1.', line)))), named_struct('events', array(named_struct('fixed', concat('1.', line)), named_struct('fixed', coalesce(extra, '2')))))"
    package = f"named_struct('package', named_struct('name', rule, 'version', cast(ord as string), 'ecosystem', 'npm'), 'groups', {groups}, 'vulnerabilities', array(named_struct('id', rule, 'affected', array(named_struct('ranges', {events})))))"
    result = f"named_struct('source', named_struct('path', path), 'packages', array({package}))"
    out = reports.advisories(documents(rows, result, '{{"results":{}}}'))
    return out.select("report", "lock", "name", "version", "cvss", F.array_join("ids", ",").alias("ids"), F.array_join("fixed", ",").alias("fixed"))


def dependencies_by_cvss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependencies from the highest score on, an unknown one counting as 0, the first by version on a tie."""
    order = [F.coalesce("cvss", F.lit(0.0)).desc(), F.col("version").cast("long"), F.col("lock"), F.col("name")]
    # ranges are found by a sample, for which the reports would be read once more
    rows = checkpointed(advisory_rollup(spark, sf_dir).select("lock", "name", "version", "cvss"))
    return ranked(rows, order, "place").select("place", "name", "version", "cvss")


def secret_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets with the first letters of their commit and date, and whether their file is still in the tree (a path of v_paths)."""
    hits = view(spark, sf_dir, "v_hits").where("line IS NOT NULL").withColumn("File", F.expr("concat('lib/f', ord % 60, CASE ord % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.xyz' END)"))
    element = "named_struct('RuleID', rule, 'File', File, 'StartLine', line, 'Commit', sha2(cast(ord as string), 256), 'Date', concat('2024-01-0', line, 'T10:00:00Z'))"
    rows = reports.secrets(documents(hits, element, "{}"))
    tree = view(spark, sf_dir, "v_paths").select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    return rows.join(tree, "file", "left").select("report", "rule", "file", "line", "commit", "date", F.coalesce("there", F.lit(False)).alias("present"))


_FILE = "regexp_replace(regexp_replace(CASE WHEN starts_with(p, '/work/app/') THEN substr(p, 11) ELSE p END, '^/src/', ''), '^\\./', '')"
_NOTE = "substr(trim(replace(regexp_replace({}, '\\s+', ' ', 'g'), '`', '''')), 1, 140)"
_SEVERITY = "CASE lower(coalesce({}, '')) WHEN 'critical' THEN 'critical' WHEN 'error' THEN 'high' WHEN 'high' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'info' END"
_HITS = f"SELECT *, {_FILE} AS file FROM (SELECT *, regexp_replace(path, '^file://', '') AS p FROM v_hits) x"


def _sql(rule: str = "rule", level: str = "level", text: str = "message", file: str = "file", line: str = "line", extra: str = "") -> str:
    return f"SELECT report, {file} AS file, CAST(coalesce({line}, 0) AS INT) AS line, {rule} AS rule, {_SEVERITY.format(level)} AS severity, {_NOTE.format(text)} AS note FROM ({_HITS}) h {extra}"


_CALLED = "CASE ord % 3 WHEN 0 THEN 'called: m@v1 m/p.F' WHEN 1 THEN 'imported, not called: m@v1 m/p' ELSE 'required, not imported: m@?' END || CASE WHEN extra IS NOT NULL THEN ', fixed in ' || extra ELSE '' END || CASE WHEN rule <> 'r1' THEN '. about ' || rule || ' {' ELSE '' END"
_FIXED = "'1.' || line || CASE WHEN coalesce(extra, '2') = '1.' || line THEN '' ELSE ',' || coalesce(extra, '2') END"
_ADVISORY = f"SELECT report, path AS lock, rule AS name, CAST(ord AS STRING) AS version, CAST(line AS DOUBLE) + 0.5 AS cvss, 'CVE-' || line || ',GHSA-' || rule AS ids, {_FIXED} AS fixed FROM v_hits WHERE line IS NOT NULL"
QUERIES = {f"parse_{n}": _query(n) for n in WRITTEN} | {f.__name__: f for f in (parse_trivy, parse_govulncheck, severity_path, advisory_rollup, dependencies_by_cvss, secret_rows)}
ORACLES = {
    name: with_views(sql, *views)
    for name, (sql, *views) in {
        "parse_semgrep": (_sql(), "v_hits"),
        "parse_bandit": (_sql(rule="concat_ws(' ', rule, extra)", text="message || CASE WHEN level IS NOT NULL THEN ' (confidence ' || lower(level) || ')' ELSE '' END"), "v_hits"),
        "parse_gosec": (_sql(rule="concat_ws(' ', rule, 'CWE-' || extra)"), "v_hits"),
        "parse_sarif": (_sql(level="coalesce(level, 'warning')"), "v_hits"),
        "parse_hadolint": (_sql(), "v_hits"),
        "parse_trivy": (_sql(rule="coalesce(nullif(rule, 'r3'), 'AVD')", text="CASE WHEN s = 'FAIL' THEN message ELSE 'plain' END", extra="CROSS JOIN (VALUES ('FAIL'), ('none')) v(s)"), "v_hits"),
        "parse_govulncheck": (
            f"SELECT report, CASE WHEN ord % 3 = 0 THEN file ELSE 'go.mod' END AS file, CAST(CASE WHEN ord % 3 = 0 THEN coalesce(line, 0) ELSE 0 END AS INT) AS line, rule, CASE WHEN ord % 3 = 0 THEN 'high' ELSE 'low' END AS severity, "
            f"{_NOTE.format(_CALLED)} AS note FROM ({_HITS}) h", "v_hits"),
        "severity_path": (f"SELECT ord, {_SEVERITY.format('level')} AS severity, file, {_NOTE.format('message')} AS note FROM ({_HITS}) h", "v_hits"),
        "advisory_rollup": (_ADVISORY, "v_hits"),
        "dependencies_by_cvss": (f"SELECT row_number() OVER (ORDER BY cvss DESC, CAST(version AS BIGINT), lock, name) AS place, name, version, cvss FROM ({_ADVISORY}) a", "v_hits"),
        "secret_rows": (
            "SELECT report, rule, h.file, CAST(line AS INT) AS line, substr(sha256(CAST(ord AS STRING)), 1, 7) AS commit, '2024-01-0' || line AS date, h.file IN (SELECT path FROM v_paths) AS present FROM "
            "(SELECT *, 'lib/f' || (ord % 60) || CASE ord % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.xyz' END AS file FROM v_hits WHERE line IS NOT NULL) h", "v_hits", "v_paths"),
    }.items()
}
