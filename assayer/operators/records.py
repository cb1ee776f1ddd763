"""Finding files: their fields and sections, the rules they have to keep, and the document and tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.checkpoints import checkpointed
from ..plans.ordering import in_blocks
from ..plans.registry import Registry
from ..plans.views import table, view
from ..sources import records

REGISTRY = Registry()
# What the fields of a finding may say.
CATEGORIES = [
    "auth", "injection", "rate-limit", "exposure", "config", "upload", "dependency", "crypto",
    "concurrency", "docs-vs-reality", "business-logic", "logging", "test-gap", "chain",
]
STATUSES, SEVERITIES, PROOFS = ["raw", "verified", "rejected"], ["CRITICAL", "HIGH", "MEDIUM", "LOW"], ["test", "static"]
REJECTIONS = ["dead_code", "unreachable", "defensive_failure", "best_practice", "no_evidence"]
REMEDIATION = ["fixed", "partial", "open", "wont_fix", "cannot_verify"]


def broken_rules(found: DataFrame) -> DataFrame:
    """(name, error) for each rule a finding file (name, and what records.findings reads) breaks; an unreadable head is an error for itself."""
    found = checkpointed(found)  # the rules and the ids read it, and its texts are taken apart in Python
    f = lambda name: F.col("fields")[name]
    r = lambda name: F.col("remediation")[name]
    said = lambda c, words: F.coalesce(c.isin(words), F.lit(False))
    code = F.regexp_extract(F.coalesce(f("rejection_reason"), F.lit("")), r"^[\w-]+", 0)
    duplicate = code.startswith("duplicate_of_")
    verified, rejected = F.coalesce(f("status") == "verified", F.lit(False)), F.coalesce(f("status") == "rejected", F.lit(False))
    carried, block = f("carried_from").isNotNull() | f("carried_run").isNotNull(), F.col("remediation").isNotNull()
    rules: dict[str, Column] = {
        "id differs from the file name": ~F.coalesce(f("id") == F.col("name"), F.lit(False)),
        "unknown category": ~said(f("category"), CATEGORIES),
        "status fixed is legacy": F.coalesce(f("status") == "fixed", F.lit(False)),
        "unknown status": ~said(f("status"), [*STATUSES, "fixed"]),
        "unknown severity": ~rejected & ~said(f("severity"), SEVERITIES),
        "unknown rejection code": rejected & ~duplicate & ~said(code, REJECTIONS),
        "no place cited": verified & ~F.col("body").rlike(r"[\w./()\[\]@-]+\.\w+:\d+"),
        "no impact": verified & (F.coalesce(scalars.section(F.col("body"), "Impact"), F.lit("")) == ""),
        "no proof": verified & said(f("severity"), ["CRITICAL", "HIGH"]) & ~said(f("proof"), PROOFS),
        "unknown proof": f("proof").isNotNull() & ~said(f("proof"), PROOFS),
        "proof without a regression test": F.coalesce(f("proof") == "test", F.lit(False)) & (F.coalesce(scalars.section(F.col("body"), "Regression Test"), F.lit("")) == ""),
        "carried from no commit": carried & ~F.coalesce(f("carried_from").rlike(r"^[0-9a-f]{7,40}$"), F.lit(False)),
        "carried from no run": carried & (F.coalesce(f("carried_run"), F.lit("")) == ""),
        "carried and raw": f("carried_from").isNotNull() & F.coalesce(f("status") == "raw", F.lit(False)),
        "remediation of an unverified finding": block & ~said(f("status"), ["verified", "fixed"]),
        "unknown remediation": block & ~said(r("status"), REMEDIATION),
        "fixed without evidence": block & F.coalesce(r("status") == "fixed", F.lit(False)) & said(F.coalesce(r("fix_evidence"), F.lit("[]")), ["[]"]),
        "public but not fixed": block & F.coalesce(r("public_safe") == "true", F.lit(False)) & ~F.coalesce(r("status") == "fixed", F.lit(False)),
        "wont_fix without a reason": block & F.coalesce(r("status") == "wont_fix", F.lit(False)) & r("verification").isNull(),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    rows = found.select("name", F.explode(F.when(F.size("errors") > 0, F.col("errors")).otherwise(broken)).alias("error"))
    ids = found.select(f("id").alias("of")).distinct()
    named = found.where(rejected & duplicate).select("name", F.regexp_extract(code, r"^duplicate_of_([\w-]+)$", 1).alias("of"))
    return rows.unionByName(named.join(ids, "of", "left_anti").select("name", F.lit("duplicate of an unknown finding").alias("error")))


_STATUS = "CASE WHEN id % 29 = 0 THEN 'fixed' WHEN id % 31 = 0 THEN 'odd' ELSE status END"
_PROOF = "CASE id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'guess' WHEN 2 THEN 'static' END"
_REASON = "CASE id % 4 WHEN 0 THEN 'dead_code - unused' WHEN 1 THEN concat('duplicate_of_f-', CAST(id - id % 3 * 100000 AS STRING)) WHEN 2 THEN 'because' END"
_FIX = "CASE id % 9 WHEN 0 THEN 'fixed' WHEN 1 THEN 'wont_fix' WHEN 2 THEN 'later' WHEN 3 THEN 'open' END"
_PLACE = "concat(file, ':', CAST(start_line AS STRING), '-', CAST(end_line AS STRING))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding file for each finding: name, text."""
    line = lambda key, value: F.expr(f"concat('{key}: ', {value}, '\\n')")
    field = lambda key, value: F.coalesce(line(key, value), F.lit(""))
    c = F.concat(
        F.lit("---\n"), line("id", "CASE WHEN id % 37 = 0 THEN 'other' ELSE concat('f-', CAST(id AS STRING)) END"), F.lit("category: "), F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("category") + 1), F.lit("  # known\n"),
        field("severity", "concat('\"', CASE WHEN id % 41 = 0 THEN 'SEVERE' ELSE severity END, '\"')"), line("status", _STATUS), field("proof", _PROOF), field("rejection_reason", _REASON),
        field("carried_from", "CASE WHEN id % 13 = 0 THEN 'abcdef12' WHEN id % 13 = 1 THEN 'main' END"), field("carried_run", "CASE WHEN id % 13 = 0 AND id % 2 = 0 THEN 'run-1' END"),
        F.coalesce(F.expr(f"concat('remediation:\\n  status: ', {_FIX}, '\\n', CASE WHEN id % 2 = 0 THEN '  fix_evidence: [\"a.ts:1\", b.ts]\\n' ELSE '  fix_evidence:\\n' END, CASE WHEN id % 7 = 0 THEN '  public_safe: true\\n' ELSE '' END)"), F.lit("")),
        F.lit("---\n## Title\n\nMissing check\n\n## Evidence\n**File**: `"), F.expr(f"CASE WHEN id % 11 = 0 THEN 'somewhere' ELSE {_PLACE} END"), F.lit("`\n"),
        F.expr("CASE WHEN id % 6 = 0 THEN '' ELSE '## Impact\\n  anyone may\\nread\\n\\n' END"), F.expr("CASE WHEN id % 10 = 0 THEN '## Regression Test\\nt.ts\\n' ELSE '' END"),
    )
    return view(spark, sf_dir, "v_findings").select(F.concat(F.lit("f-"), F.col("id").cast("string")).alias("name"), c.alias("text"))


_F = f"SELECT *, 'f-' || id AS name, {_STATUS} AS st, {_PROOF} AS proof, {_REASON} AS reason, {_FIX} AS fix, CASE WHEN id % 41 = 0 THEN 'SEVERE' ELSE severity END AS sev FROM v_findings"
_RULES = {
    "id differs from the file name": "id % 37 = 0", "status fixed is legacy": "st = 'fixed'", "unknown status": "st = 'odd'", "unknown severity": "st <> 'rejected' AND sev = 'SEVERE'",
    "unknown rejection code": "st = 'rejected' AND id % 4 IN (2, 3)", "no place cited": "st = 'verified' AND id % 11 = 0", "no impact": "st = 'verified' AND id % 6 = 0",
    "no proof": "st = 'verified' AND sev IN ('CRITICAL', 'HIGH') AND coalesce(proof, '') NOT IN ('test', 'static')", "unknown proof": "proof = 'guess'", "proof without a regression test": "proof = 'test' AND id % 10 <> 0",
    "carried from no commit": "id % 13 = 1", "carried from no run": "id % 13 = 1 OR (id % 13 = 0 AND id % 2 = 1)", "carried and raw": "id % 13 < 2 AND st = 'raw'",
    "remediation of an unverified finding": "fix IS NOT NULL AND st NOT IN ('verified', 'fixed')", "unknown remediation": "fix = 'later'", "fixed without evidence": "fix = 'fixed' AND id % 2 = 1",
    "public but not fixed": "fix IS NOT NULL AND id % 7 = 0 AND fix <> 'fixed'", "wont_fix without a reason": "fix = 'wont_fix'",
    "duplicate of an unknown finding": "st = 'rejected' AND id % 4 = 1 AND 'f-' || (id - id % 3 * 100000) NOT IN (SELECT name FROM f WHERE id % 37 <> 0)",
}


@REGISTRY.query(f", f AS ({_F}) " + " UNION ALL ".join(f"SELECT name, '{e}' AS error FROM f WHERE {rule}" for e, rule in _RULES.items()), "v_findings")
def finding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a finding file breaks."""
    return broken_rules(records.findings(files(spark, sf_dir)))


def location(body: Column) -> Column:
    """file, start_line, end_line of the place a finding names in its File line, or else first in its text; null without one."""
    named = F.regexp_extract(body, r"\*\*File\*\*:?[^\n]*?([\w.()\[\]@-]+(?:/[\w.()\[\]@-]+)*\.\w+(?::\d+(?:\s*[-–]\s*\d+)?)?)", 1)
    first = F.regexp_extract(body, r"([\w.()\[\]@-]+(?:/[\w.()\[\]@-]+)*\.\w+:\d+(?:\s*[-–]\s*\d+)?)", 1)
    cite = F.when(named != "", named).otherwise(first)
    part = lambda n: F.nullif(F.regexp_extract(cite, r"^([^:]+)(?::(\d+)(?:\s*[-–]\s*(\d+))?)?$", n), F.lit(""))
    start = part(2).cast("int")
    return F.when(cite != "", F.struct(scalars.plain_path(part(1)).alias("file"), start.alias("start_line"), F.greatest(start, F.coalesce(part(3).cast("int"), start)).alias("end_line")))


@REGISTRY.query("SELECT 'f-' || id AS name, CASE WHEN id % 11 <> 0 THEN file END AS file, CASE WHEN id % 11 <> 0 THEN start_line END AS start_line, CASE WHEN id % 11 <> 0 THEN end_line END AS end_line, 'Missing check' AS title, CASE WHEN id % 6 <> 0 THEN 'anyone may' || chr(10) || 'read' END AS impact FROM v_findings", "v_findings")
def finding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place, title and impact that a finding file names."""
    found = records.findings(files(spark, sf_dir)).withColumn("l", location(F.col("body")))
    return found.select("name", "l.file", "l.start_line", "l.end_line", scalars.section(F.col("body"), "Title").alias("title"), scalars.section(F.col("body"), "Impact").alias("impact"))


@REGISTRY.query(
    f", f AS ({_F}) SELECT 'f-' || id AS id, sev AS severity, coalesce(CASE WHEN fix = 'later' THEN 'later' ELSE fix END, 'open') AS state, coalesce(proof, 'static') AS proof, coalesce(fix, 'open') = 'fixed' AS public_safe, {_PLACE} AS place FROM f WHERE st = 'verified' AND id % 37 <> 0 AND id % 11 <> 0",
    "v_findings",
)
def remediation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the remediation document: verified findings with the state of their remediation and their place."""
    found = records.findings(files(spark, sf_dir)).withColumn("l", location(F.col("body")))
    state = F.coalesce(F.col("remediation")["status"], F.lit("open"))
    rows = found.where((F.col("fields")["status"] == "verified") & (F.col("fields")["id"] == F.col("name")) & F.col("l").isNotNull())
    place = F.concat("l.file", F.lit(":"), "l.start_line", F.lit("-"), "l.end_line")
    return rows.select(F.col("fields")["id"].alias("id"), F.col("fields")["severity"].alias("severity"), state.alias("state"), F.coalesce(F.col("fields")["proof"], F.lit("static")).alias("proof"), (state == "fixed").alias("public_safe"), place.alias("place"))


@REGISTRY.query(
    "SELECT CAST(class AS STRING) AS class, status, count(*) AS n, CAST(sum(CASE WHEN evidence % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS cited FROM v_ledger WHERE class <> 4 GROUP BY class, status UNION ALL SELECT '4', 'not valid JSON', 1, 0 FROM v_ledger WHERE class = 4 HAVING count(*) > 0",
    "v_ledger",
)
def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger files of the classes read back: rows and cited evidence by state, and the classes whose files break off, once each. A class has as many files as it has blocks of rows."""
    entry = "named_struct('class', class, 'target', target, 'status', status, 'auditor', auditor, 'evidence', IF(evidence % 2 = 0, array('a', 'b'), array()))"
    text = F.concat(F.lit('{"schema_version":"1.0","entries":'), F.to_json(F.collect_list(F.expr(entry))), F.when(F.col("class") == 4, "").otherwise("}"))
    read = records.ledgers(in_blocks(view(spark, sf_dir, "v_ledger")).groupBy("class", "_block").agg(text.alias("text")).drop("_block"))
    said = lambda status, cited, bad: F.struct(status.alias("status"), cited.cast("long").alias("cited"), F.lit(bad).alias("bad"))
    rows = F.when(F.col("error").isNotNull(), F.array(said(F.col("error"), F.lit(0), True))).otherwise(F.transform("entries", lambda e: said(e["status"], F.size(e["evidence"]), False)))
    counted = read.select(F.col("class").cast("string").alias("class"), F.explode(rows).alias("e")).groupBy("class", "e.status", "e.bad").agg(F.count("*").alias("n"), F.sum("e.cited").alias("cited"))
    return counted.select("class", "status", F.when(F.col("bad"), 1).otherwise(F.col("n")).cast("long").alias("n"), "cited")


@REGISTRY.query("SELECT CAST(l_suppkey % 50 AS STRING) AS name, 'c' || l_linenumber AS class, l_returnflag AS \"check\", CASE WHEN l_linenumber % 2 = 0 THEN 'why ' || l_orderkey || ' · more' ELSE 'why ' || l_orderkey END AS why FROM lineitem")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of Markdown tables."""
    row = "concat('| c', l_linenumber, ' | ', l_returnflag, ' | why ', l_orderkey, IF(l_linenumber % 2 = 0, ' | more |', ' |  |'))"
    text = F.concat(F.lit("# Gaps\n\n| Category | Check | Why |\n|---|---|---|\n"), F.array_join(F.collect_list(F.expr(row)), "\n"))
    return records.markdown_rows(in_blocks(table(spark, sf_dir, "lineitem")).groupBy(F.expr("CAST(l_suppkey % 50 AS STRING)").alias("name"), "_block").agg(text.alias("text")).drop("_block"))


@REGISTRY.query("SELECT 'm' || user_id || '/r' || event_id % 40 AS response, event_id AS ord, event_id % 1000 AS input, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE event_id % 11 END AS cache_5m, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 0 END AS cache_1h, 0 AS cache_read, event_id % 13 AS output FROM events WHERE event_id % 17 <> 0")
def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the lines of sessions; lines of other kinds don't count, and a plain count of written cache is one of five minutes."""
    counts = "'input_tokens', event_id % 1000, 'output_tokens', event_id % 13, 'cache_creation_input_tokens', event_id % 11, 'cache_creation', IF(event_id % 3 = 0, named_struct('ephemeral_5m_input_tokens', event_id % 7, 'ephemeral_1h_input_tokens', event_id % 5), NULL)"
    message = f"IF(event_id % 17 = 0, 'plain line', to_json(named_struct('requestId', concat('r', event_id % 40), 'timestamp', '2024-01-01T00:00:00Z', 'message', named_struct('id', concat('m', user_id), 'usage', named_struct({counts})))))"
    return records.usage(table(spark, sf_dir, "events").selectExpr("event_id AS ord", f"{message} AS text")).drop("at")


@REGISTRY.query(f"SELECT id, '\"[' || severity || '] ' || CASE WHEN id % 9 = 0 THEN '''=x' ELSE 'finding' END || '\"' AS summary, priority FROM (SELECT id, severity, {scalars.case_sql(scalars.JIRA, 'severity', 'Medium')} AS priority FROM v_findings WHERE id % 9 <> 0) x", "v_findings")
def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an issue tracker's table."""
    rows = view(spark, sf_dir, "v_findings").where("id % 9 <> 0")
    return rows.select("id", scalars.csv_cell(F.concat(F.lit("["), "severity", F.lit("] finding"))).alias("summary"), scalars.looked_up(scalars.JIRA, F.col("severity"), "Medium").alias("priority"))


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
