"""Runs kept as versions: archived under names that don't collide, replaced as a whole, read from the newest on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpointed, shared_folder
from ..plans.ordering import ranked
from ..plans.registry import Registry
from ..plans.views import table, view

REGISTRY = Registry()
# Letters of a run's time, marks of own rows, and why a run can't stand in.
STAMP = 19
OWN, OWN_END = "| Stack profile |", r"\(prepass\) \|$"
GAP_HEAD = "| Category | Check | Why not assessed |\n|---|---|---|"
REASONS = {
    "missing": "no previous audit in .security-audit/",
    "unfinished": "the previous audit has no report.md (it did not finish)",
    "no commit": "the previous audit recorded no git commit",
    "partial": 'the previous audit was partial (scope "{}"), so it cannot stand in for the rest of the code',
    "empty": "the previous audit left no findings or non-issues to carry",
}


def run_key(name: Column) -> Column:
    """A run's name so that names sort by time and then by the number behind it, -10 after -9."""
    return F.when(F.length(name) > STAMP, F.concat(F.substring(name, 1, STAMP), F.lit("~"), F.lpad(F.substr(name, F.lit(STAMP + 2)), 4, "0"))).otherwise(name)


def finished(runs: DataFrame) -> DataFrame:
    """runs (name, report, ..) that have a report, with key: order by it, from the last on, for the newest first."""
    return runs.where(F.coalesce("report", F.lit(False))).withColumn("key", run_key(F.col("name")))


def free_name(names: DataFrame, when: str) -> str:
    """when, or when-2, when-3 and so on: behind the last of names (name) that begins with it."""
    taken = names.where(F.col("name").startswith(when)).select(F.when(F.col("name") == when, 1).when(F.col("name").rlike(rf"^{re.escape(when)}-\d+$"), F.substr("name", F.lit(len(when) + 2)).cast("int")).alias("n"))
    last = taken.agg(F.max("n")).first()[0]
    return when if last is None else f"{when}-{last + 1}"


def archive(rows: DataFrame, folder: str, when: str) -> str:
    """Writes rows as a run of its own into the history at folder and gives its name. Runs archived at one time get numbers."""
    return replace(rows, folder, free_name(archived(rows.sparkSession, folder), when))


def replace(rows: DataFrame, folder: str, name: str) -> str:
    """Puts rows in the place of the run of that name, of which nothing stays, and leaves the others alone; doing it again changes nothing."""
    rows.withColumn("run", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)
    return name


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the runs in the history at folder; none where there is no such folder. The names come from the folders alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return spark.createDataFrame([(n.removeprefix("run="),) for n in found if n.startswith("run=")], "name string")


def snapshot(findings: DataFrame) -> DataFrame:
    """id, category, severity, title, file, start_line, end_line, fixed of findings that are verified, or fixed as runs of old say it."""
    rows = findings.where(F.col("status").isin("verified", "fixed"))
    fixed = (F.col("status") == "fixed") | F.coalesce(F.col("remediation") == "fixed", F.lit(False))
    return rows.select("id", "category", F.upper(F.coalesce("severity", F.lit(""))).alias("severity"), F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("file", F.lit("")).alias("file"), "start_line", "end_line", fixed.alias("fixed"))


def stand_in(runs: DataFrame) -> DataFrame:
    """runs (name, there, report, commit, scope, findings, non_issues) with ok and reason: the first one why a run can't be carried over, in the order of REASONS."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    before, after = REASONS["partial"].split("{}")
    reason = (
        F.when(~F.coalesce("there", F.lit(False)), REASONS["missing"]).when(~F.coalesce("report", F.lit(False)), REASONS["unfinished"]).when(blank("commit"), REASONS["no commit"])
        .when(~blank("scope"), F.concat(F.lit(before), "scope", F.lit(after))).when(F.coalesce("findings", F.lit(0)) + F.coalesce("non_issues", F.lit(0)) == 0, REASONS["empty"])
    )
    return runs.withColumns({"ok": reason.isNull(), "reason": reason})


def merged_gaps(documents: DataFrame, rows: DataFrame, tools: list[str]) -> DataFrame:
    """documents (name, text) of gaps with this run's rows (name, n, line) in the place of the rows of runs before it.

    A line counts as own if it ends in (prepass) and names a tool or the stack profile; all others stay as they are, in their order.
    Rows go behind them by n, a head before the first table. Documents without rows lose their own rows only; without a text they begin with a head.
    Doing it again changes nothing. Each document's lines are one array, so nothing moves but its new rows.
    """
    new = rows.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("new"))
    mine = lambda line: line.rlike(OWN_END) & (line.startswith(OWN) | F.exists(F.array(*map(F.lit, tools)), lambda t: line.contains(t)))
    text = F.coalesce("text", F.lit(""))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~mine(line)), "\n")
    joined = documents.join(new, "name", "left").withColumn("kept", kept)
    body = F.regexp_replace("kept", r"\n+\z", "")
    headed = F.when(body.contains("| Category |"), body).when(body != "", F.concat(F.lit(GAP_HEAD + "\n"), body)).otherwise(F.lit(GAP_HEAD))
    return joined.select("name", F.when(F.col("new").isNull(), F.col("kept")).otherwise(F.concat(headed, F.lit("\n"), "new", F.lit("\n"))).alias("text"))


_NAME = "concat(substring(CAST(l_shipdate AS STRING), 1, 10), 'T09-00-0', CAST(l_linenumber AS STRING), CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE concat('-', CAST(l_orderkey % 5 * 4 AS STRING)) END)"


@REGISTRY.query(
    f"WITH r AS (SELECT DISTINCT {_NAME.replace('STRING', 'VARCHAR')} AS name FROM lineitem WHERE l_suppkey % 4 <> 0) SELECT name, row_number() OVER (ORDER BY substring(name, 1, 19) DESC, CAST(coalesce(nullif(substring(name, 21), ''), '0') AS INT) DESC) AS n FROM r"
)
def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs by their names from the newest on."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr(_NAME).alias("name"), F.expr("l_suppkey % 4 <> 0").alias("report"))
    return ranked(finished(rows).select("name", "key").distinct(), [F.desc("key")], "n").select("name", "n")


@REGISTRY.query(
    "SELECT id, category, severity, file, start_line, id % 7 = 0 AS fixed, CAST(run AS VARCHAR) || '-2' AS run FROM v_findings WHERE (status = 'verified' OR id % 7 = 0) AND run % 2 = 0 AND severity <> 'LOW' UNION ALL "
    "SELECT id, category, severity, file, start_line, id % 7 = 0, CAST(run AS VARCHAR) FROM v_findings WHERE (status = 'verified' OR id % 7 = 0) AND run % 2 = 1",
    "v_findings",
)
def archived_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of findings archived in two halves; one of them comes twice under one time and is replaced once more, and the newest of each time is read."""
    rows = view(spark, sf_dir, "v_findings").withColumn("status", F.expr("CASE WHEN id % 7 = 0 THEN 'fixed' ELSE status END"))
    shown = rows.join(snapshot(rows.withColumns({"title": F.lit("t"), "remediation": F.lit(None).cast("string")})).select("id", "fixed"), "id").select("id", "category", "severity", "file", "start_line", "fixed", F.col("run").alias("month"))
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    archive(shown.where("month % 2 = 1"), folder, "2024-01-01T00-00-00")
    archive(shown.where("month % 2 = 0"), folder, "2024-02-01T00-00-00")
    name = archive(shown.where("month % 2 = 0"), folder, "2024-02-01T00-00-00")
    replace(shown.where("month % 2 = 0 AND severity <> 'LOW'"), folder, name)
    runs = finished(archived(spark, folder).withColumn("report", F.lit(True)))
    newest = runs.groupBy(F.substring("name", 1, STAMP).alias("time")).agg(F.max_by("name", "key").alias("run"))
    out = checkpointed(spark.read.parquet(folder).withColumn("run", F.col("run").cast("string")).join(F.broadcast(newest), "run"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out.select("id", "category", "severity", "file", "start_line", "fixed", F.concat("month", F.substr("run", F.lit(STAMP + 1))).alias("run"))


_FACTS = ["o_orderkey AS name", "o_orderkey % 11 <> 0 AS there", "o_orderkey % 7 <> 0 AS report", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS commit", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS scope", "o_custkey % 4 AS findings", "o_custkey % 2 AS non_issues"]


@REGISTRY.query(
    f"""SELECT name, reason IS NULL AS ok, reason FROM (SELECT *, CASE WHEN NOT there THEN '{REASONS['missing']}' WHEN NOT report THEN '{REASONS['unfinished']}' WHEN commit IS NULL THEN '{REASONS['no commit']}' WHEN scope <> '' THEN concat('{REASONS['partial'].split('{}')[0]}', scope, '{REASONS['partial'].split('{}')[1]}')
  WHEN findings + non_issues = 0 THEN '{REASONS['empty']}' END AS reason FROM (SELECT {', '.join(_FACTS)} FROM orders))"""
)
def previous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order, as a run, can stand in for a part of the next one, and why not."""
    return stand_in(table(spark, sf_dir, "orders").selectExpr(*_FACTS)).select("name", "ok", "reason")


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
