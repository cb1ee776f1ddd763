"""URL filters by a temporal list: dated entries become validity intervals, captures are judged by those active when fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, small, table, text_of

ENTRIES = "entry string, action string, since timestamp"
#: The dated list of the query op6, as fixed values: block, allow, or drop (from then on the entry no longer counts).
LIST = [
    ("spam-farm.example.org", "block", "2024-01-10"), ("spam-farm.example.org", "drop", "2024-04-01"), ("spam-farm.example.org", "block", "2024-06-15"),
    ("example.net", "block", "2024-03-01"), ("example.net", "drop", "2024-05-01"), ("blog.ththan.example.net", "allow", "2024-03-15"),
    ("m.therou.example.com", "block", "2024-02-01"), ("example.com/fr", "block", "2024-07-01"), ("blog.tiontion.example.com/en", "block", "2024-01-01"),
]


def intervals(entries: DataFrame) -> DataFrame:
    """entry (in lower case), action, since, until: each action of an entry holds until its next one. Of actions at one time block goes before allow before drop."""
    entries = entries.withColumn("entry", F.lower("entry"))
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    own = entries.where("entry IS NOT NULL AND since IS NOT NULL").groupBy("entry", "since").agg(F.min_by("action", rank).alias("action"))
    until = F.lead("since").over(Window.partitionBy("entry").orderBy("since"))
    return own.withColumn("until", until).where("action <> 'drop'")


def judged(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures and verdict (block, allow or none), listed_entry, listed_since.

    An entry is a host, which holds for its subdomains, or a host and the first part of a path. A capture has a key for each
    host above its own, with and without the first part of its path; an as-of join finds the intervals of these keys that
    hold its fetch time, from since on and before until. The longest entry decides, of equally long ones the one first by name. If a
    count shows that the list is small it is broadcast, and only what it hits is shuffled, the best entry of equal
    captures being found before that. A large list is joined by entry; then distinct (url, time) are judged once, so a hot
    host's copies don't meet in a task.

    A null or empty url, one without a host, and a null time have the verdict none. Repeated captures each keep a row; empty tables are
    taken. Other columns are kept; those of these names are replaced.
    """
    captures = captures.drop("verdict", "listed_entry", "listed_since")
    rows = captures.select(F.struct(*(captures[f"`{c}`"] for c in captures.columns)).alias("_row"), F.col(url_col).alias("_url"), F.col(time_col).alias("_time"))
    timed = rows.select("_url", "_time").where("_url IS NOT NULL AND _time IS NOT NULL")
    listed = checkpointed(intervals(entries))
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    distinct = timed if few else timed.distinct()
    host = F.lower(F.regexp_extract(text_of("_url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract("_url", r"^[^:]+://[^/?#]+/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.when(path != "", F.concat(above, F.transform(above, lambda h: F.concat(h, F.lit("/"), F.lower(path))))).otherwise(above)
    keyed = distinct.select("_url", "_time", F.explode(F.when(host != "", keys)).alias("entry"))
    valid = (F.col("_time") >= F.col("since")) & (F.col("until").isNull() | (F.col("_time") < F.col("until")))
    hits = keyed.join(F.broadcast(listed) if few else listed, "entry").where(valid)
    first = F.min(F.struct((-F.length("entry")).alias("l"), "entry", "since", "action")).alias("b")
    best = hits.groupBy("_url", "_time").agg(first).select("_url", "_time", F.col("b.action").alias("verdict"), F.col("b.entry").alias("listed_entry"), F.col("b.since").alias("listed_since"))
    joined = rows.join(small(best), ["_url", "_time"], "left")
    return joined.select("_row.*", F.coalesce("verdict", F.lit("none")).alias("verdict"), "listed_entry", "listed_since")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that its id names, since the table has none."""
    fetched = F.expr("timestamp'2024-01-01 12:00:00' + make_dt_interval(cast(page_id % 366 AS INT))")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    listed = spark.createDataFrame(LIST, "entry string, action string, since string").withColumn("since", F.to_timestamp("since"))
    out = judged(pages, listed)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("page_id", "url", day("fetched_at").alias("fetched_on"), "verdict", "listed_entry", day("listed_since").alias("listed_on"))


ORACLE = f"""
WITH e AS (SELECT entry, action, CAST(since AS TIMESTAMP) AS since, lead(CAST(since AS TIMESTAMP)) OVER (PARTITION BY entry ORDER BY since) AS until
  FROM (VALUES {", ".join(map(str, LIST))}) t(entry, action, since)),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(page_id % 366 AS INT)) AS at,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)', 1)) AS part FROM pages),
h AS (SELECT p.page_id, p.at, e.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(e.entry) DESC, e.entry) AS r FROM p JOIN e
  ON e.action <> 'drop' AND p.at >= e.since AND (e.until IS NULL OR p.at < e.until)
  AND ('.' || p.host LIKE '%.' || split_part(e.entry, '/', 1)) AND (NOT contains(e.entry, '/') OR split_part(e.entry, '/', 2) = p.part))
SELECT p.page_id, p.url, strftime(p.at, '%Y-%m-%d') AS fetched_on, coalesce(h.action, 'none') AS verdict, h.entry AS listed_entry, strftime(h.since, '%Y-%m-%d') AS listed_on
FROM p LEFT JOIN h ON h.page_id = p.page_id AND h.r = 1
"""
