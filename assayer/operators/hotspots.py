"""Hotspots: texts and entry points scored by the rule registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.views import table, view, with_views
from .rules import AREA_CAP, AREAS, SINKS, hits, points, points_sql, reasons, reasons_sql

#: Points of the kinds of entry points.
KINDS = {"webhook": 2, "server-action": 2, "http-route": 1, "job": 1, "page": 0}


def scored(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, score and reasons of each text: capped points of its areas plus the points of what is found in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = texts.select(key, F.explode(F.array(F.struct(text.alias("text"), F.lower(text).alias("lower")))).alias("t"))
    found = both.select(key, F.explode(F.array(hits(AREAS + SINKS, F.col("t.text"), F.col("t.lower")))).alias("hits"))
    score = F.least(F.lit(AREA_CAP), points(AREAS, F.col("hits"))) + points(SINKS, F.col("hits"), len(AREAS))
    return found.select(key, score.alias("score"), reasons(AREAS + SINKS, F.col("hits")).alias("reasons"))


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def hotspots_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top(scored(docs, "doc_id", "text").where("score > 0"), 20, F.desc("score"), "doc_id")


def _scored_sql(key: str, text: str, source: str) -> str:
    t = f"coalesce({text}, '')"
    return f"SELECT {key}, least({AREA_CAP}, {points_sql(AREAS, t)}) + {points_sql(SINKS, t)} AS score, {reasons_sql(AREAS + SINKS, t)} AS reasons FROM {source}"


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "pages"), "page_id", "html")


def kind_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return view(spark, sf_dir, "v_entries").select("entry", "kind", F.coalesce(weight[F.col("kind")], F.lit(0)).alias("weight"))


def next_entries(entries: DataFrame) -> DataFrame:
    """Each entry with the next strictly later line that has an entry in its file, else 120 lines on."""
    later = Window.partitionBy("file").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    return entries.withColumn("next_line", F.coalesce(F.min("line").over(later), F.col("line") + 120))


def next_entry_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_entries(view(spark, sf_dir, "v_entries")).select("entry", "file", "line", "next_line")


def entry_sites(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """How many sites lie in the body of each entry. The equality on file deals the rows, the range is checked within."""
    bodies = next_entries(entries).select("entry", "file", "line", "next_line")
    at = sites.select(F.col("file").alias("site_file"), "start_line")
    within = (F.col("file") == F.col("site_file")) & (F.col("start_line") >= F.col("line")) & (F.col("start_line") < F.col("next_line"))
    return bodies.join(at, within, "left").groupBy("entry").agg(F.count("start_line").alias("sites"))


def entry_site_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_sites(view(spark, sf_dir, "v_entries"), view(spark, sf_dir, "v_findings").where("status = 'raw'"))


def scope_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten entries by weight, and every entry that shares a place with them or is a webhook."""
    entries = view(spark, sf_dir, "v_entries")
    weights = kind_weight(spark, sf_dir).select("entry", "weight")
    places = top(entries.join(weights, "entry"), 10, F.desc("weight"), "file", "line", "entry").select("file", "line").distinct()
    near = entries.join(F.broadcast(places.withColumn("near", F.lit(True))), ["file", "line"], "left")
    return near.where("near OR kind = 'webhook'").select("entry", "file", "line", "kind")


def twin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array_sort(F.collect_list(F.struct("entry", "name")))
    rows = view(spark, sf_dir, "v_entries").groupBy("file", "line", "kind").agg(named.alias("twins"))
    return rows.select("file", "line", "kind", F.array_join(F.transform("twins", lambda t: t["name"]), ", ").alias("names"))


_NEXT = "SELECT *, coalesce(min(line) OVER (PARTITION BY file ORDER BY line RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), line + 120) AS next_line FROM v_entries"
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in KINDS.items()) + " ELSE 0 END"
QUERIES = {f.__name__: f for f in (hotspots_top20, page_scores, kind_weight, next_entry_line, entry_site_range_join, scope_select, twin_merge)}
ORACLES = {
    "hotspots_top20": f"SELECT * FROM ({_scored_sql('doc_id', 'text', 'documents')}) s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "page_scores": _scored_sql("page_id", "html", "pages"),
    "kind_weight": with_views(f"SELECT entry, kind, {_WEIGHT} AS weight FROM v_entries", "v_entries"),
    "next_entry_line": with_views(f"SELECT entry, file, line, next_line FROM ({_NEXT}) n", "v_entries"),
    "entry_site_range_join": with_views(
        f"SELECT entry, count(s.start_line) AS sites FROM ({_NEXT}) e LEFT JOIN (SELECT * FROM v_findings WHERE status = 'raw') s "
        "ON s.file = e.file AND s.start_line >= e.line AND s.start_line < e.next_line GROUP BY entry", "v_entries", "v_findings"),
    "scope_select": with_views(
        f"SELECT entry, file, line, kind FROM v_entries WHERE kind = 'webhook' OR (file, line) IN "
        f"(SELECT (file, line) FROM (SELECT file, line FROM v_entries ORDER BY {_WEIGHT} DESC, file, line, entry LIMIT 10) t)", "v_entries"),
    "twin_merge": with_views("SELECT file, line, kind, string_agg(name, ', ' ORDER BY entry) AS names FROM v_entries GROUP BY ALL", "v_entries"),
}
