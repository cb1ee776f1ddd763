"""Scanner candidates, the coverage ledger, usage and the import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpointed
from ..plans.views import table, view, with_views

#: Severities of scanners from the worst on, the rows a report shows, audit classes, the share of words of titles that are alike, prices a million tokens.
RANKS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SHOWN = 40
CLASSES = 14
ALIKE = 0.6
PRICE_IN, PRICE_OUT, CACHE_WRITE, CACHE_READ = 5.0, 25.0, 1.25, 0.1


def deduplicated(rows: DataFrame) -> DataFrame:
    """Of the rows with one file, line and rule the most severe, the earliest on a tie; an aggregate, so copies meet before the shuffle."""
    rank = F.array_position(F.array(*(F.lit(s) for s in RANKS)), F.col("severity"))
    best = F.min(F.struct(rank.alias("rank"), "ord", "severity", "tool")).alias("b")
    return rows.groupBy("file", "line", "rule").agg(best).select("file", "line", "rule", "b.severity", "b.tool", "b.ord", "b.rank")


def candidates_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(view(spark, sf_dir, "v_candidates")).drop("rank")


def candidates_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows per tool as a report shows them, each with the whole number."""
    rows = deduplicated(view(spark, sf_dir, "v_candidates"))
    per = Window.partitionBy("tool")
    rows = rows.withColumn("place", F.row_number().over(per.orderBy("rank", "file", "line", "rule")))
    totals = rows.groupBy("tool").agg(F.count("*").alias("total"))
    return rows.where(F.col("place") <= SHOWN).join(totals, "tool").select("tool", "place", "file", "line", "rule", "severity", "total")


def ledger_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = [F.count_if(F.col("status") == s).alias(s) for s in ("checked", "not_assessed", "not_applicable")]
    targets = F.count_distinct(F.when(F.col("status") == "checked", F.col("target"))).alias("targets")
    writers = F.array_join(F.array_sort(F.collect_set("auditor")), ", ").alias("auditors")
    return view(spark, sf_dir, "v_ledger").groupBy("class").agg(*per, targets, writers)


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.range(CLASSES).select(F.col("id").cast("int").alias("class"))
    return every.join(view(spark, sf_dir, "v_ledger").select("class").distinct(), "class", "left_anti")  # a class a row, not a ledger's every row


def uncovered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = view(spark, sf_dir, "v_ledger").select(F.col("target").alias("file"))
    return view(spark, sf_dir, "v_entries").join(ledger, "file", "left_anti").select("entry", "file", "line")


def ledger_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = view(spark, sf_dir, "v_findings").select(F.col("id").alias("evidence"))
    return view(spark, sf_dir, "v_ledger").join(findings, "evidence", "left_anti").groupBy("class").agg(F.count("*").alias("dangling"))


def usage_dedup(rows: DataFrame) -> DataFrame:
    """One record a response: the largest output, the last on a tie."""
    kept = F.max(F.struct("output", "ord", "input", "cache_5m", "cache_read")).alias("k")
    return rows.groupBy("response").agg(kept).select("response", "k.*")


def usage_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_dedup(view(spark, sf_dir, "v_usage"))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_dedup(view(spark, sf_dir, "v_usage"))
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("input", "output", "cache_5m", "cache_read")}
    cost = (total["input"] * PRICE_IN + total["output"] * PRICE_OUT + total["cache_5m"] * (PRICE_IN * CACHE_WRITE) + total["cache_read"] * (PRICE_IN * CACHE_READ)) / 1e6
    return rows.agg(*(v.alias(k) for k, v in total.items()), F.round(cost, 4).alias("cost"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every node that leads to the start nodes, those included: semi-naive steps, the reached set written at each."""
    back = edges.select(F.col("dst").alias("node"), "src").distinct()
    reached = fresh = checkpointed(start.select("node").distinct())
    while fresh.limit(1).count():
        fresh = checkpointed(back.join(fresh, "node").select(F.col("src").alias("node")).distinct().join(reached, "node", "left_anti"))
        reached = reached.unionByName(fresh)
    return reached


def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that imports one of three, directly or not, over all edges: back edges, self loops and cycles included."""
    return closure(view(spark, sf_dir, "v_edges"), spark.range(590, 593).select(F.col("id").alias("node")))


def import_closure_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """import_closure, by the name that it had while that one was cut."""
    return import_closure(spark, sf_dir)


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their number from 1, counted per document with those that are not blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") != "").alias("filled"), F.max(F.when(F.trim("line") != "", F.col("at") + 1)).alias("last_filled"))


def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+/", ""), r"[?#].*", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, r"/+$", "").alias("path"))


def note_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.substring(F.trim(F.regexp_replace(F.translate("text", "`", "'"), r"[ \t\n\r]+", " ")), 1, 140)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", note.alias("note"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per turn the number of turns within three places, and the last system turn before or at it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    last = F.last(F.when(F.col("role") == "system", F.col("turn")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = F.count("*").over(order.rowsBetween(-3, 3))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", near.alias("near"), last.alias("system_turn"))


def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.when(F.col("text").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col("text"))).otherwise(F.col("text"))
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", quoted.alias("cell"))


def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of one brand and size whose names share at least 0.6 of their words.

    Parts whose names have the same words are one kind. Kinds meet under one of the n - ceil(0.6 n) + 1 first of their n words, one of which two alike ones share,
    and their parts only then, so that the work grows with the kinds and the pairs that come out.
    """
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " ")), " "))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.array_sort(words).alias("words")).where("p_brand IS NOT NULL AND p_size IS NOT NULL AND words IS NOT NULL")
    group = ["p_brand", "p_size"]
    kinds = rows.select(*group, "words").distinct()
    least = F.size("words") - F.ceil(F.size("words") * (ALIKE - 5e-5) - 1e-9).cast("int") + 1  # a share is rounded to four places
    keys = kinds.withColumn("word", F.explode(F.slice("words", F.lit(1), least)))
    share = F.size(F.array_intersect("words", "theirs")) / F.size(F.array_union("words", "theirs"))
    met = keys.join(keys.withColumnRenamed("words", "theirs"), [*group, "word"]).select(*group, "words", "theirs").distinct()
    alike = met.withColumn("share", F.round(share, 4)).where(F.col("share") >= ALIKE)
    other = rows.select(F.col("p_partkey").alias("other"), *group, F.col("words").alias("theirs"))
    # the parts are few bytes and the pairs many, so the tasks don't follow the bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(alike, [*group, "words"]).repartition(parts, *group, "theirs").join(other, [*group, "theirs"]).where("p_partkey < other").select("p_partkey", "other", "share")


def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts by severity and status with subtotals."""
    return view(spark, sf_dir, "v_findings").rollup("severity", "status").agg(F.count("*").alias("n"))


_DEDUP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule ORDER BY rank, ord) AS r FROM (SELECT *, CASE severity " + " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(RANKS)) + " END AS rank FROM v_candidates) a) b WHERE r = 1"
_USAGE = "SELECT response, output, ord, input, cache_5m, cache_read FROM (SELECT *, row_number() OVER (PARTITION BY response ORDER BY output DESC, ord DESC) AS r FROM v_usage) u WHERE r = 1"
QUERIES = {
    f.__name__: f
    for f in (
        candidates_dedup, candidates_capped, ledger_matrix, missing_classes, uncovered_entries, ledger_referential, usage_responses, usage_cost,
        import_closure, import_closure_whole, line_explode, path_normalise, note_normalise, context_window, csv_escape, title_jaccard, rollup_cube,
    )
}
ORACLES = {
    name: with_views(sql, *views) if views else sql
    for name, (sql, *views) in {
        "candidates_dedup": (f"SELECT file, line, rule, severity, tool, ord FROM ({_DEDUP}) d", "v_candidates"),
        "candidates_capped": (f"SELECT tool, place, file, line, rule, severity, total FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY rank, file, line, rule) AS place, count(*) OVER (PARTITION BY tool) AS total FROM ({_DEDUP}) d) e WHERE place <= {SHOWN}", "v_candidates"),
        "ledger_matrix": (
            "SELECT class, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("checked", "not_assessed", "not_applicable"))
            + ", count(DISTINCT target) FILTER (WHERE status = 'checked') AS targets, string_agg(DISTINCT auditor, ', ' ORDER BY auditor) AS auditors FROM v_ledger GROUP BY class", "v_ledger"),
        "missing_classes": (f"SELECT CAST(i AS INT) AS class FROM range({CLASSES}) t(i) WHERE i NOT IN (SELECT class FROM v_ledger)", "v_ledger"),
        "uncovered_entries": ("SELECT entry, file, line FROM v_entries e WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.target = e.file)", "v_entries", "v_ledger"),
        "ledger_referential": ("SELECT class, count(*) AS dangling FROM v_ledger l WHERE NOT EXISTS (SELECT 1 FROM v_findings f WHERE f.id = l.evidence) GROUP BY class", "v_ledger", "v_findings"),
        "usage_responses": (_USAGE, "v_usage"),
        "usage_cost": (
            "SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(coalesce(sum(cache_5m), 0) AS BIGINT) AS cache_5m, CAST(sum(cache_read) AS BIGINT) AS cache_read, "
            f"round((sum(input) * {PRICE_IN}::DOUBLE + sum(output) * {PRICE_OUT}::DOUBLE + coalesce(sum(cache_5m), 0) * {PRICE_IN * CACHE_WRITE}::DOUBLE + sum(cache_read) * {PRICE_IN * CACHE_READ}::DOUBLE) / 1e6, 4) AS cost FROM ({_USAGE}) u", "v_usage"),
        "import_closure": (
            ", r AS (SELECT CAST(i AS BIGINT) AS node FROM range(590, 593) t(i) UNION SELECT e.src FROM v_edges e JOIN r ON e.dst = r.node) SELECT node FROM r", "v_edges"),
        "import_closure_whole": (
            ", r AS (SELECT CAST(i AS BIGINT) AS node FROM range(590, 593) t(i) UNION SELECT e.src FROM v_edges e JOIN r ON e.dst = r.node) SELECT node FROM r", "v_edges"),
        "line_explode": ("SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) <> '') AS filled, CAST(max(CASE WHEN trim(line) <> '' THEN pos END) AS INT) AS last_filled FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) d GROUP BY doc_id",),
        "path_normalise": (r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*', ''), '/+$', '') AS path FROM pages",),
        "note_normalise": (r"SELECT conv_id, turn, substr(trim(regexp_replace(replace(text, '`', ''''), '[ \t\n\r]+', ' ', 'g')), 1, 140) AS note FROM conversations",),
        "context_window": ("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS system_turn FROM conversations",),
        "csv_escape": (r"""SELECT conv_id, turn, '"' || replace(CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END, '"', '""') || '"' AS cell FROM conversations""",),
        "title_jaccard": (
            "WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')), ' ')) AS w FROM part) "
            "SELECT * FROM (SELECT a.p_partkey, b.p_partkey AS other, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 4) AS share FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey) s WHERE share >= 0.6",),
        "rollup_cube": ("SELECT severity, status, count(*) AS n FROM v_findings GROUP BY ROLLUP (severity, status)", "v_findings"),
    }.items()
}
