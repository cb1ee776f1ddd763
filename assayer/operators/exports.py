"""Findings as documents of other tools: SARIF, tables of issue trackers, the remediation document; each bounded, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.checkpoints import checkpointed, shared_folder
from ..plans.registry import Registry
from ..plans.views import view
from ..sources import reports
from ..sources.documents import remove_documents, write_documents
from ..sources.tree import LARGEST, SOURCE, inventory, tree

REGISTRY = Registry()
#: Findings of a document at most.
PER_DOCUMENT = 5000
# Names in documents.
TOOL = {"name": "security-audit", "version": "1.1.0"}
SARIF_SCHEMA, SARIF_VERSION, ROOT_ID = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0", "%SRCROOT%"
CLOSED = ["fixed", "wont_fix"]
STATES = ["fixed", "partial", "open", "wont_fix", "cannot_verify"]
LINEAR_HEAD, JIRA_HEAD = ["Title", "Description", "Priority", "Labels"], ["Summary", "Description", "Issue Type", "Priority", "Labels", "Labels"]


def numbered(items: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """items (run, id, ..) with document, by which no document has more than per_document of them, whatever a run has.

    Runs are dealt by hash into parts of about half as many, which are counted off by id.
    """
    sizes = items.groupBy("run").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 2 / per_document)).cast("long").alias("parts"))
    dealt = items.join(sizes, "run").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    n = F.row_number().over(Window.partitionBy("run", "part").orderBy("id")) - 1
    return dealt.withColumn("document", F.concat_ws("-", "run", "part", F.floor(n / per_document).cast("string"))).drop("parts", "part")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sarif_documents(items: DataFrame, runs: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """(path, text) of SARIF 2.1.0: a rule and a result for each of items (run, id, category, severity, title, impact, fix, proof, status, file, start_line, end_line).

    A result has a place if its file is known, and a region if its line is. runs (run, commit, date) that have no items have a
    valid document without results. Items are in the order of their ids.
    """
    level = scalars.looked_up(scalars.LEVELS, F.col("severity"), "warning")
    said = F.when(_text("fix") != "", F.concat(F.lit("Fix: "), "fix")).otherwise(F.lit("See the finding."))
    rule = F.struct(
        F.col("id"), F.col("category").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.when(_text("impact") != "", F.col("impact")).otherwise(F.col("title")).alias("text")).alias("fullDescription"),
        F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(said.alias("text")).alias("help"),
        F.struct(F.array_compact(F.array(F.lit("security"), F.when(_text("category") != "", F.col("category")))).alias("tags"), scalars.looked_up(scalars.SECURITY_SEVERITY, F.col("severity"), "5.5").alias("security-severity"),
                 F.when(F.col("proof") == "test", "very-high").otherwise("high").alias("precision")).alias("properties"),
    )
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"), F.coalesce("end_line", "start_line").alias("endLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri"), F.lit(ROOT_ID).alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.when(_text("impact") != "", F.concat_ws(". ", "title", "impact")).otherwise(F.col("title"))
    result = F.struct(F.col("id").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.struct("severity", "category", "proof", F.col("status").alias("remediation_status")).alias("properties"),
                      F.when(F.col("file").isNotNull(), F.array(place)).alias("locations"))
    rows = numbered(items, per_document).groupBy("run", "document").agg(F.array_sort(F.collect_list(F.struct("id", rule.alias("rule"), result.alias("result")))).alias("rows"))
    every = runs.join(rows, "run", "left").withColumn("document", F.coalesce("document", F.concat("run", F.lit("-0-0"))))
    indexed = F.transform("rows", lambda r, i: r["result"].withField("ruleIndex", i))
    results = F.coalesce(F.to_json(indexed), F.lit("[]"))
    driver = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in TOOL.items()), F.lit(TOOL["version"]).alias("semanticVersion")))
    rules = F.coalesce(F.to_json(F.transform("rows", lambda r: r["rule"])), F.lit("[]"))
    about = F.struct(_text("commit").alias("audited_commit"), _text("date").alias("audit_date"))
    text = F.concat(F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'), F.rtrim(driver, F.lit("}")), F.lit(',"rules":'), rules, F.lit('}},"results":'), results, F.lit(',"properties":'), F.to_json(about), F.lit("}]}\n"))
    return every.select(F.concat("document", F.lit(".sarif")).alias("path"), text.alias("text"))


def place_text(file: Column, start: Column, end: Column) -> Column:
    """file:start-end, as far as it is known."""
    lines = F.when(start.isNull(), "").when(F.coalesce(end, start) != start, F.concat(F.lit(":"), start, F.lit("-"), end)).otherwise(F.concat(F.lit(":"), start))
    return F.when(file.isNull(), "").otherwise(F.concat(file, lines))


def tracker_documents(items: DataFrame, tracker: str, per_document: int = PER_DOCUMENT) -> DataFrame:
    """(path, text) of CSV for an issue tracker, linear or jira: quoted cells, lines that end in CR LF, a head in each document."""
    where = place_text(F.col("file"), F.col("start_line"), F.col("end_line"))
    title = F.concat(F.lit("["), "severity", F.lit("] "), "title", F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""))
    said = F.concat_ws("\n\n", F.concat(F.lit("Finding "), "id", F.lit(" ("), "severity", F.lit(", "), "category", F.lit(", status: "), "status", F.lit(")")), F.concat(F.lit("Location: "), F.when(where != "", where).otherwise("not cited")),
                       F.when(_text("impact") != "", F.concat(F.lit("Impact:\n"), "impact")), F.concat(F.lit("Fix:\n"), F.when(_text("fix") != "", F.col("fix")).otherwise("See the finding file.")))
    if tracker == "linear":
        head, cells = LINEAR_HEAD, [title, said, scalars.looked_up(scalars.LINEAR, F.col("severity"), "Medium"), F.concat_ws(", ", F.lit("security"), F.when(_text("category") != "", F.col("category")))]
    elif tracker == "jira":
        head, cells = JIRA_HEAD, [title, said, F.lit("Bug"), scalars.looked_up(scalars.JIRA, F.col("severity"), "Medium"), F.lit("security"), F.regexp_replace(_text("category"), r"\s+", "-")]
    else:
        raise ValueError(f"no tracker {tracker}")
    line = F.concat(F.concat_ws(",", *map(scalars.csv_cell, cells)), F.lit("\r\n"))
    first = ",".join(f'"{h}"' for h in head) + "\r\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda r: r["line"])
    rows = numbered(items, per_document).groupBy("document").agg(F.concat(F.lit(first), F.array_join(lines, "")).alias("text"))
    return rows.select(F.concat("document", F.lit(f".{tracker}.csv")).alias("path"), "text")


def remediation_documents(items: DataFrame, runs: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """(path, text) of the remediation document: a summary of the whole run, and the entries of items (.., verified, status) that are verified.

    The entries of a large run stand in several documents, each with the summary of all.
    """
    counts = [F.count_if(F.col("verified") & (F.col("status") == s)).alias(s) for s in STATES]
    summary = items.groupBy("run").agg(F.count_if("verified").alias("verified_total"), *counts, F.count_if(~F.col("verified")).alias("cleared"))
    entry = F.struct("id", "category", "severity", "title", F.col("status").alias("remediation_status"), (F.col("status") == "fixed").alias("public_safe"))
    rows = numbered(items.where("verified"), per_document).groupBy("run", "document").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("entries"))
    every = runs.join(summary, "run", "left").join(rows, "run", "left")
    names = ["verified_total", *STATES, "cleared"]
    text = F.concat(F.lit('{"schema_version":"1.0","summary":'), F.to_json(F.struct(*(F.coalesce(n, F.lit(0)).alias(n) for n in names))), F.lit(',"findings":'), F.coalesce("entries", F.lit("[]")), F.lit("}\n"))
    return every.select(F.concat(F.coalesce("document", F.concat("run", F.lit("-0-0"))), F.lit(".json")).alias("path"), text.alias("text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the documents' tables by run, some without a file or lines, with odd letters in their titles."""
    return view(spark, sf_dir, "v_findings").selectExpr(
        "CAST(run AS STRING) AS run", "CAST(id AS STRING) AS id", "concat('c', CAST(category AS STRING)) AS category", "severity", _TITLE + " AS title", "CASE WHEN id % 3 = 0 THEN 'it \"hurts\"' END AS impact", "CASE WHEN id % 4 = 0 THEN 'mend it' END AS fix",
        "'static' AS proof", f"{_STATUS} AS status", "status = 'verified' AS verified", "CASE WHEN id % 13 <> 0 THEN file END AS file", "CASE WHEN id % 5 <> 0 THEN start_line END AS start_line", "CASE WHEN id % 5 <> 0 THEN end_line END AS end_line",
    )


_TITLE = "concat(CASE id % 6 WHEN 0 THEN '=sum(' WHEN 1 THEN '-x, ' ELSE 'Missing check ' END, CAST(id % 50 AS STRING), CASE WHEN id % 7 = 0 THEN ' \"q\" ; é' ELSE '' END)"
_STATUS = "CASE id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' WHEN 2 THEN 'partial' WHEN 3 THEN 'wont_fix' ELSE 'cannot_verify' END"
_ITEMS = (
    f", items AS (SELECT CAST(run AS VARCHAR) AS run, CAST(id AS VARCHAR) AS id, concat('c', CAST(category AS VARCHAR)) AS category, severity, {_TITLE} AS title, CASE WHEN id % 3 = 0 THEN 'it \"hurts\"' ELSE '' END AS impact, CASE WHEN id % 4 = 0 THEN 'mend it' ELSE '' END AS fix, "
    f"{_STATUS} AS status, status = 'verified' AS verified, CASE WHEN id % 13 <> 0 THEN file END AS file, CASE WHEN id % 5 <> 0 THEN start_line END AS start_line, CASE WHEN id % 5 <> 0 THEN end_line END AS end_line FROM v_findings)"
)


def _shown(spark: SparkSession, documents: DataFrame, read) -> DataFrame:
    """What read(folder) finds in documents once they are written; the folder goes."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(documents, folder)
    out = checkpointed(read(folder))
    remove_documents(spark, folder)
    return out


def _runs_of(items: DataFrame) -> DataFrame:
    none = items.sparkSession.range(1).select(F.lit("none").alias("run"))  # a local row would take a Python worker a core
    return items.select("run").distinct().unionByName(none).select("run", F.lit("abc1234").alias("commit"), F.lit("2024-01-01").alias("date"))


@REGISTRY.query(
    _ITEMS + f""" SELECT id AS rule, coalesce(file, '') AS file, CASE WHEN file IS NULL THEN 0 ELSE coalesce(start_line, 0) END AS line, CASE {scalars.case_sql(scalars.LEVELS, "severity", "warning")} WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'info' END AS severity,
  trim(title || CASE WHEN impact <> '' THEN '. ' || impact ELSE '' END) AS note FROM items WHERE status NOT IN ('fixed', 'wont_fix')""",
    "v_findings",
)
def sarif_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings written as SARIF documents of at most 500 results and read back as a scanner's report."""
    items = _items(spark, sf_dir).where(~F.col("status").isin(CLOSED))
    read = lambda folder: reports.sarif(spark.read.text(folder, wholetext=True, pathGlobFilter="*.sarif").select(F.lit("r").alias("report"), F.col("value").alias("text")))
    return _shown(spark, sarif_documents(items, _runs_of(items), 500), read).drop("report")


@REGISTRY.query(
    _ITEMS + f""" SELECT concat('[', severity, '] ', title, CASE WHEN file IS NULL THEN '' ELSE concat(' (', file, CASE WHEN start_line IS NULL THEN '' WHEN end_line <> start_line THEN concat(':', start_line, '-', end_line) ELSE concat(':', start_line) END, ')') END) AS summary,
  concat('Finding ', id, ' (', severity, ', ', category, ', status: ', status, ')', chr(10), chr(10), 'Location: ', CASE WHEN file IS NULL THEN 'not cited' ELSE concat(file, CASE WHEN start_line IS NULL THEN '' WHEN end_line <> start_line THEN concat(':', start_line, '-', end_line) ELSE concat(':', start_line) END) END,
  CASE WHEN impact <> '' THEN concat(chr(10), chr(10), 'Impact:', chr(10), impact) ELSE '' END, chr(10), chr(10), 'Fix:', chr(10), CASE WHEN fix <> '' THEN fix ELSE 'See the finding file.' END) AS description, {scalars.case_sql(scalars.JIRA, "severity", "Medium")} AS priority, category AS label FROM items""",
    "v_findings",
)
def tracker_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as CSV for a tracker and read back."""
    schema = "summary string, description string, type string, priority string, label1 string, label string"
    read = lambda folder: spark.read.csv(folder, schema=schema, header=True, multiLine=True, quote='"', escape='"', lineSep="\r\n", pathGlobFilter="*.csv", enforceSchema=True)
    return _shown(spark, tracker_documents(_items(spark, sf_dir), "jira", 500), read).select("summary", "description", "priority", "label")


_COUNTED = ", ".join(f"CAST(count(*) FILTER (verified AND status = '{s}') AS BIGINT) AS {s}" for s in STATES)


@REGISTRY.query(_ITEMS + f", s AS (SELECT run, CAST(count(*) FILTER (verified) AS BIGINT) AS verified_total, {_COUNTED}, CAST(count(*) FILTER (NOT verified) AS BIGINT) AS cleared FROM items GROUP BY run) SELECT i.id, i.title, i.status AS state, i.status = 'fixed' AS public_safe, s.* EXCLUDE (run) FROM items i JOIN s USING (run) WHERE verified", "v_findings")
def remediation_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remediation documents of all runs, written and read back, an entry a row with its run's summary."""
    items = _items(spark, sf_dir)
    names = ["verified_total", *STATES, "cleared"]
    shape = f"summary struct<{', '.join(f'{n}: long' for n in names)}>, findings array<struct<id: string, title: string, remediation_status: string, public_safe: boolean>>"
    read = lambda folder: spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.from_json("value", shape).alias("d")).select("d.summary.*", F.explode("d.findings").alias("f"))
    rows = _shown(spark, remediation_documents(items, _runs_of(items), 500), read)
    return rows.select("f.id", "f.title", F.col("f.remediation_status").alias("state"), "f.public_safe", *names)


_TREE = "CASE WHEN doc_id % 11 = 0 THEN concat('node_modules/', path) WHEN doc_id % 13 = 0 THEN concat('p', CAST(doc_id AS STRING), '/go.sum') ELSE concat('p', CAST(doc_id % 17 AS STRING), '/', path) END"


@REGISTRY.query(
    f", f AS (SELECT {_TREE.replace('STRING', 'VARCHAR')} AS path, text FROM v_js) SELECT path, list_extract(string_split(path, '/'), -1) AS name, octet_length(encode(text)) AS size, ends_with(path, 'go.sum') AS lockfile, CASE WHEN ends_with(path, 'go.sum') THEN NULL ELSE md5(text) END AS digest FROM f "
    f"WHERE NOT starts_with(path, 'node_modules/') AND (ends_with(path, 'go.sum') OR (regexp_matches(path, '{SOURCE}') AND octet_length(encode(text)) < {LARGEST}))",
    "v_js",
)
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as a source tree and read from its folders again."""
    files = view(spark, sf_dir, "v_js").select(F.expr(_TREE).alias("path"), "text")
    return _shown(spark, files, lambda folder: tree(spark, folder).select("path", "name", "size", "lockfile", F.md5("text").alias("digest")))


@REGISTRY.query(
    f", f AS (SELECT path, list_extract(string_split(path, '/'), -1) AS name FROM (SELECT {_TREE.replace('STRING', 'VARCHAR')} AS path FROM v_js) WHERE NOT starts_with(path, 'node_modules/')) SELECT what, count(*) AS n FROM (SELECT unnest([{', '.join(f'''CASE WHEN regexp_matches(name, '{p}') THEN 'language {k}' END''' for k, p in scalars.LANGUAGES.items())}]) AS what FROM f) WHERE what IS NOT NULL GROUP BY what",
    "v_js",
)
def tree_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree of the documents holds, by language."""
    files = view(spark, sf_dir, "v_js").select(F.expr(_TREE).alias("path"), "text")
    return _shown(spark, files, lambda folder: inventory(tree(spark, folder, files="all"))).select("what", "n")


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
