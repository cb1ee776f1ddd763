"""Findings: counts, verdicts, constraints, grouping by place, and matching with an answer key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.views import view, with_views

#: Severities from the worst on, with the points of each.
SEVERITIES = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SAME_PLACE = 15
WINDOW = 2


def severity_points(severity: Column) -> Column:
    points = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return F.coalesce(points[severity], F.lit(0))


def _points_sql(severity: str) -> str:
    return f"CASE {severity} " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in SEVERITIES.items()) + " ELSE 0 END"


def findings_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_findings").groupBy("status", "severity", "category").agg(F.count("*").alias("n"))


def severity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "v_findings").where("status = 'verified'")
    return found.groupBy("run").agg(F.sum(severity_points(F.col("severity"))).alias("score"), F.count("*").alias("n"))


def severity_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three prerequisites lower the severity by one, four or more by two; CRITICAL stays, and LOW is the least."""
    points = severity_points(F.col("severity"))
    step = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("prerequisites") >= 4, 2).when(F.col("prerequisites") >= 2, 1).otherwise(0)
    names = F.array(*(F.lit(s) for s in reversed(SEVERITIES)))
    return view(spark, sf_dir, "v_findings").select("id", F.element_at(names, F.greatest(F.lit(1), points - step)).alias("effective"))


def report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "v_findings")
    counted = found.groupBy("run", "status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("run"))
    return counted.withColumn("share", F.round(F.col("n") / F.greatest(F.lit(1), total), 6))


def ci_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: unresolved findings by severity, and fail if one is HIGH or worse."""
    open_ = view(spark, sf_dir, "v_findings").where("status <> 'rejected'")
    per = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    worst = F.max(severity_points(F.col("severity")))
    return open_.groupBy("run").agg(*per, F.when(worst >= SEVERITIES["HIGH"], "fail").otherwise("pass").alias("verdict"))


def islands(found: DataFrame) -> DataFrame:
    """Findings of a file that lie within SAME_PLACE lines of a chain of others are one group, named by its first line."""
    order = Window.partitionBy("file").orderBy("start_line", "id")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("start_line") - reach > SAME_PLACE), F.col("start_line"))
    return found.withColumn("first", starts).withColumn("group_line", F.last("first", ignorenulls=True).over(order))


def same_place_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands(view(spark, sf_dir, "v_findings").where("status = 'raw'"))
    return rows.groupBy("file", "group_line").agg(F.count("*").alias("n"), F.max("end_line").alias("last_line"))


def nearest_places(found: DataFrame, key: DataFrame, window: int = WINDOW) -> DataFrame:
    """(file, start_line, end_line, lo, hi, distance): for each place of found the places of key at the least distance, which is at most window lines.

    Findings of one place are one here, and so are entries, so copies of either make no more pairs.
    """
    spots = found.select("file", "start_line", "end_line").where("file IS NOT NULL").distinct()
    entries = key.select(F.col("file").alias("key_file"), "lo", "hi").distinct()
    gap = F.greatest(F.lit(0), F.col("lo") - F.col("end_line"), F.col("start_line") - F.col("hi"))
    pairs = spots.join(entries, (F.col("file") == F.col("key_file")) & (gap <= window)).withColumn("distance", gap)
    rank = F.rank().over(Window.partitionBy("file", "start_line", "end_line").orderBy("distance"))
    return pairs.withColumn("r", rank).where("r = 1").select("file", "start_line", "end_line", "lo", "hi", "distance")


def beside(rows: DataFrame, places: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """rows beside those of places that agree in columns, null being equal to null."""
    same = [places[c].alias(f"_{c}") if c in columns else places[c] for c in places.columns]
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return rows.join(places.select(*same), on, how).drop(*(f"_{c}" for c in columns))


def nearest(found: DataFrame, key: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per finding all key entries at the least distance, which is at most window lines. Findings and entries come in once their places have met."""
    near = beside(found.select("id", "status", "file", "start_line", "end_line"), nearest_places(found, key, window), ["file", "start_line", "end_line"])
    return beside(near, key.select("file", "lo", "hi", "key_id", "kind"), ["file", "lo", "hi"]).select("id", "status", "key_id", "kind", "distance")


def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(view(spark, sf_dir, "v_findings"), view(spark, sf_dir, "v_key"))


def recall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded entries found by a verified finding, only by a rejected one, or missed; and recall."""
    key = view(spark, sf_dir, "v_key").where("kind = 'seeded'")
    found, spot = view(spark, sf_dir, "v_findings"), ["file", "start_line", "end_line"]
    said = found.groupBy(*spot).agg(F.max(F.when(F.col("status") == "verified", 2).when(F.col("status") == "rejected", 1).otherwise(0)).alias("best"))
    # findings that are nearest to an entry are nearest to all of its place
    best = beside(nearest_places(found, view(spark, sf_dir, "v_key")), said, spot).groupBy("file", "lo", "hi").agg(F.max("best").alias("best"))
    state = beside(key, best, ["file", "lo", "hi"], "left").select(F.coalesce("best", F.lit(0)).alias("best"))
    hit = F.count_if(F.col("best") == 2)
    return state.agg(
        F.count("*").alias("seeded"), hit.alias("found"), F.count_if(F.col("best") == 1).alias("dropped"),
        F.count_if(F.col("best") == 0).alias("missed"), F.round(hit / F.nullif(F.count("*"), F.lit(0)), 3).alias("recall"),
    )


def ci_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with findings in the last run but in none before it."""
    found = view(spark, sf_dir, "v_findings")
    last = found.agg(F.max("run").alias("last"))
    marked = found.join(F.broadcast(last))
    return marked.groupBy("file").agg(F.min("run").alias("first_run"), F.max("last").alias("last")).where("first_run = last").select("file", "first_run")


_NEAREST = (
    "SELECT * FROM (SELECT p.*, rank() OVER (PARTITION BY id ORDER BY distance) AS r FROM (SELECT f.id, f.status, k.key_id, k.kind, "
    "greatest(0, k.lo - f.end_line, f.start_line - k.hi) AS distance FROM v_findings f JOIN v_key k ON f.file = k.file) p "
    f"WHERE distance <= {WINDOW}) q WHERE r = 1"
)
QUERIES = {
    f.__name__: f
    for f in (findings_by_status, severity_score, severity_downgrade, report_buckets, ci_verdict, same_place_islands, nearest_interval, recall_score, ci_scope)
}
ORACLES = {
    name: with_views(sql, *views)
    for name, (sql, *views) in {
        "findings_by_status": ("SELECT status, severity, category, count(*) AS n FROM v_findings GROUP BY ALL", "v_findings"),
        "severity_score": (f"SELECT run, CAST(sum({_points_sql('severity')}) AS BIGINT) AS score, count(*) AS n FROM v_findings WHERE status = 'verified' GROUP BY run", "v_findings"),
        "severity_downgrade": (
            f"SELECT id, CASE greatest(1, {_points_sql('severity')} - CASE WHEN severity = 'CRITICAL' THEN 0 WHEN prerequisites >= 4 THEN 2 WHEN prerequisites >= 2 THEN 1 ELSE 0 END) "
            "WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS effective FROM v_findings", "v_findings"),
        "report_buckets": ("SELECT run, status, n, round(CAST(n AS DOUBLE) / greatest(1, sum(n) OVER (PARTITION BY run)), 6) AS share FROM (SELECT run, status, count(*) AS n FROM v_findings GROUP BY ALL) c", "v_findings"),
        "ci_verdict": (
            "SELECT run, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in SEVERITIES)
            + f", CASE WHEN max({_points_sql('severity')}) >= 3 THEN 'fail' ELSE 'pass' END AS verdict FROM v_findings WHERE status <> 'rejected' GROUP BY run", "v_findings"),
        "same_place_islands": (
            "SELECT file, group_line, count(*) AS n, max(end_line) AS last_line FROM (SELECT file, end_line, max(first) OVER (PARTITION BY file ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS group_line FROM "
            f"(SELECT *, CASE WHEN reach IS NULL OR start_line - reach > {SAME_PLACE} THEN start_line END AS first FROM (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach "
            "FROM v_findings WHERE status = 'raw') a) b) c GROUP BY file, group_line", "v_findings"),
        "nearest_interval": (f"SELECT id, status, key_id, kind, distance FROM ({_NEAREST}) n", "v_findings", "v_key"),
        "recall_score": (
            "SELECT count(*) AS seeded, count(*) FILTER (WHERE best = 2) AS found, count(*) FILTER (WHERE best = 1) AS dropped, count(*) FILTER (WHERE best = 0) AS missed, "
            "round(CAST(count(*) FILTER (WHERE best = 2) AS DOUBLE) / nullif(count(*), 0), 3) AS recall FROM (SELECT k.key_id, coalesce(max(CASE h.status WHEN 'verified' THEN 2 WHEN 'rejected' THEN 1 ELSE 0 END), 0) AS best "
            f"FROM v_key k LEFT JOIN ({_NEAREST}) h ON h.key_id = k.key_id WHERE k.kind = 'seeded' GROUP BY k.key_id) s", "v_findings", "v_key"),
        "ci_scope": ("SELECT file, min(run) AS first_run FROM v_findings GROUP BY file HAVING min(run) = (SELECT max(run) FROM v_findings)", "v_findings"),
    }.items()
}
