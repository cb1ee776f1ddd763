"""Summaries of findings, ledgers and runs, the gaps of a coverage ledger, and orders of what a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordering import ranked
from ..plans.registry import Registry
from ..plans.views import view
from .findings import SAME_PLACE, SEVERITIES, islands

REGISTRY = Registry()
#: States of a remediation, reasons for a rejection, states of a ledger row, families of categories in the order of their shards.
REMEDIATION = ["fixed", "partial", "open", "wont_fix", "cannot_verify"]
STATES = ["checked", "not_applicable", "not_assessed"]
FAMILY_OF = {c: (0 if c < 4 else 1 if c < 10 else 2) for c in range(14)}
SHARD, ALONE = 15, 25
PHASES = ["Pre-pass", "Recon", "Audit", "Verification", "Test quality", "Report"]

_REASON = "CASE id % 6 WHEN 0 THEN 'dead_code' WHEN 1 THEN concat('duplicate_of_auth-', CAST(id % 9 AS STRING), ' - same') WHEN 2 THEN 'best_practice: style' WHEN 3 THEN NULL WHEN 4 THEN 'no_evidence' ELSE 'unreachable ' END"
_FIX = "CASE id % 7 WHEN 0 THEN 'fixed' WHEN 1 THEN 'partial' WHEN 2 THEN 'wont_fix' WHEN 3 THEN 'cannot_verify' WHEN 4 THEN NULL ELSE 'open' END"


@REGISTRY.query(
    f"SELECT run, code, count(*) AS n FROM (SELECT run, CASE WHEN starts_with(c, 'duplicate_of_') THEN 'duplicate' WHEN c = '' THEN '?' ELSE c END AS code FROM (SELECT run, regexp_extract(coalesce({_REASON}, ''), '^[\\w-]+') AS c FROM v_findings WHERE status = 'rejected') x) y GROUP BY run, code",
    "v_findings",
)
def rejection_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected findings by the code their reason begins with; all duplicates are one code, none is ?."""
    code = F.regexp_extract(F.coalesce(F.expr(_REASON), F.lit("")), r"^[\w-]+", 0)
    folded = F.when(code.startswith("duplicate_of_"), "duplicate").when(code == "", "?").otherwise(code)
    return view(spark, sf_dir, "v_findings").where("status = 'rejected'").groupBy("run", folded.alias("code")).agg(F.count("*").alias("n"))


@REGISTRY.query(
    f"SELECT run, count(*) FILTER (WHERE status = 'verified') AS verified_total, {', '.join(f'''count(*) FILTER (WHERE status = 'verified' AND coalesce({_FIX}, 'open') = '{s}') AS {s}''' for s in REMEDIATION)}, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM v_findings GROUP BY run",
    "v_findings",
)
def remediation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified findings by the state of their remediation, none being open, and rejected ones."""
    rows = view(spark, sf_dir, "v_findings").withColumn("fix", F.coalesce(F.expr(_FIX), F.lit("open")))
    verified = F.col("status") == "verified"
    per = [F.count_if(verified & (F.col("fix") == s)).alias(s) for s in REMEDIATION]
    return rows.groupBy("run").agg(F.count_if(verified).alias("verified_total"), *per, F.count_if(F.col("status") == "rejected").alias("rejected"))


@REGISTRY.query("SELECT count(*) AS entries, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATES) + ", count(DISTINCT class) AS classes, count(DISTINCT CASE WHEN status = 'checked' THEN target END) AS targets FROM v_ledger", "v_ledger")
def coverage_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in one line."""
    targets = F.count_distinct(F.when(F.col("status") == "checked", F.col("target"))).alias("targets")
    return view(spark, sf_dir, "v_ledger").agg(F.count("*").alias("entries"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES), F.count_distinct("class").alias("classes"), targets)


@REGISTRY.query("SELECT row_number() OVER (ORDER BY count(*) DESC, category) AS place, category, count(*) AS n, string_agg(DISTINCT CAST(run AS STRING), ', ' ORDER BY CAST(run AS STRING)) AS runs FROM v_findings WHERE status = 'rejected' GROUP BY category", "v_findings")
def safe_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by what was found to be safe in them, the most first."""
    rows = view(spark, sf_dir, "v_findings").where("status = 'rejected'").groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("run").cast("string"))), ", ").alias("runs"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))  # one row a category


_AUDITOR = "concat('auditor', CAST(id % 9 AS STRING))"


@REGISTRY.query(
    f", f AS (SELECT {_AUDITOR} AS auditor, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in SEVERITIES) + f" FROM v_findings WHERE status <> 'rejected' GROUP BY {_AUDITOR}), "
    "l AS (SELECT auditor, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATES) + " FROM v_ledger GROUP BY auditor) "
    "SELECT coalesce(f.auditor, l.auditor) AS auditor, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*(s.lower() for s in SEVERITIES), *STATES]) + ", CASE WHEN l.auditor IS NOT NULL THEN 'done' ELSE 'running' END AS state FROM f FULL JOIN l ON f.auditor = l.auditor",
    "v_findings", "v_ledger",
)
def auditor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings and ledger rows of each auditor: done with a ledger, running with findings only."""
    open_ = view(spark, sf_dir, "v_findings").where("status <> 'rejected'").groupBy(F.expr(_AUDITOR).alias("auditor")).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))
    ledger = view(spark, sf_dir, "v_ledger").groupBy("auditor").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES), F.lit("done").alias("state"))
    joined = open_.join(ledger, "auditor", "full")
    return joined.select("auditor", *(F.coalesce(c, F.lit(0)).alias(c) for c in [*(s.lower() for s in SEVERITIES), *STATES]), F.coalesce("state", F.lit("running")).alias("state"))


@REGISTRY.query("SELECT state, count(*) AS tools, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT rule, count(line) AS n, CASE WHEN count(line) = 0 THEN 'skipped' WHEN count(*) % 3 = 0 THEN 'failed' WHEN count(*) % 3 = 1 THEN 'not-run' ELSE 'ran' END AS state FROM v_hits GROUP BY rule) t GROUP BY state", "v_hits")
def tool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools and their hits by how their run ended."""
    n, every = F.count("line"), F.count("*")
    state = F.when(n == 0, "skipped").when(every % 3 == 0, "failed").when(every % 3 == 1, "not-run").otherwise("ran")
    return view(spark, sf_dir, "v_hits").groupBy("rule").agg(n.alias("n"), state.alias("state")).groupBy("state").agg(F.count("*").alias("tools"), F.sum("n").alias("hits"))


def severity_rank(severity: Column, unknown: int) -> Column:
    """The place of a severity from the worst on; reports differ in where an unknown one stands."""
    names = list(SEVERITIES)
    return F.coalesce(*(F.when(severity == s, n) for n, s in enumerate(names)), F.lit(unknown))


_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(SEVERITIES)) + " ELSE {} END"


@REGISTRY.query(f"SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY {_RANK.format(4)}, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END, id) AS place FROM v_findings WHERE status = 'verified'", "v_findings")
def findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified findings of a run numbered by severity, those proven by a test first, then by id."""
    order = Window.partitionBy("run").orderBy(severity_rank(F.col("severity"), 4), F.when(F.col("id") % 2 == 0, 0).otherwise(1), "id")
    return view(spark, sf_dir, "v_findings").where("status = 'verified'").select("run", "id", F.row_number().over(order).alias("place"))


@REGISTRY.query("SELECT category, id, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY run DESC, id DESC) AS place FROM v_findings WHERE status = 'raw') x WHERE place <= 6", "v_findings")
def latest_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six open findings of each category, the newest first."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("run"), F.desc("id")))
    return view(spark, sf_dir, "v_findings").where("status = 'raw'").withColumn("place", place).where("place <= 6").select("category", "id", "severity", "place")


@REGISTRY.query(
    "SELECT entry, n, CASE WHEN n > 3 THEN array_to_string(names[1:3], '; ') || '; and ' || (n - 3) || ' more' ELSE array_to_string(names, '; ') END AS shown FROM (SELECT file AS entry, count(*) AS n, list(name ORDER BY line, entry) AS names FROM v_entries GROUP BY file) x",
    "v_entries",
)
def first_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three names of each file and how many more there are."""
    rows = view(spark, sf_dir, "v_entries").groupBy(F.col("file").alias("entry")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line", "entry", "name")))["name"].alias("names"))
    more = F.when(F.col("n") > 3, F.concat(F.lit("; and "), F.col("n") - 3, F.lit(" more"))).otherwise("")
    return rows.select("entry", "n", F.concat(F.array_join(F.slice("names", 1, 3), "; "), more).alias("shown"))


def phase_times(ends: DataFrame) -> DataFrame:
    """run, phase, ms of (run, n, phase, ended_at, started_at): the time since the phase before ended, null where either end is unknown or runs backwards."""
    before = F.coalesce(F.lag("ended_at").over(Window.partitionBy("run").orderBy("n")), F.when(F.col("n") == 0, F.col("started_at")))
    before = F.when(F.col("n") == 0, F.col("started_at")).otherwise(F.lag("ended_at").over(Window.partitionBy("run").orderBy("n")))
    return ends.withColumn("before", before).select("run", "phase", F.when(F.col("ended_at") >= F.col("before"), F.col("ended_at") - F.col("before")).alias("ms"))


_ENDS = "SELECT user_id AS run, CAST(event_id % 6 AS INT) AS n, min(CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id * 1000 % 7919000 END) AS ended_at, 1000 AS started_at FROM events GROUP BY user_id, event_id % 6"


@REGISTRY.query(
    f"SELECT run, n AS phase, CASE WHEN ended_at >= before THEN ended_at - before END AS ms FROM (SELECT *, CASE WHEN n = 0 THEN started_at ELSE lag(ended_at) OVER (PARTITION BY run ORDER BY n) END AS before FROM ({_ENDS}) e) x"
)
def phase_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.views import table

    at = F.when(F.col("event_id") % 17 != 0, F.col("event_id") * 1000 % 7919000)
    ends = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), (F.col("event_id") % 6).cast("int").alias("n")).agg(F.min(at).alias("ended_at"), F.lit(1000).alias("started_at"))
    return phase_times(ends.withColumn("phase", F.col("n")))


def grouped_places(found: DataFrame) -> DataFrame:
    """found with group_id (the least id of findings at the same place) and, of each group, what orders it: family, file, line, id."""
    named = islands(found).withColumn("group_id", F.min("id").over(Window.partitionBy("file", "group_line")))
    family = F.create_map(*(F.lit(x) for pair in FAMILY_OF.items() for x in pair))[F.col("category")]
    first = F.min_by(F.struct(family.alias("family"), "file", "start_line", "id"), F.struct("start_line", "id"))
    return named.groupBy("file", "group_line").agg(F.count("*").alias("n"), first.alias("first"))


_ISLANDS = (
    "SELECT *, max(first) OVER (PARTITION BY file ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS group_line FROM (SELECT *, CASE WHEN reach IS NULL OR start_line - reach > "
    f"{SAME_PLACE} THEN start_line END AS first FROM (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_findings WHERE status = 'raw') a) b"
)
_FAMILY = "CASE WHEN category < 4 THEN 0 WHEN category < 10 THEN 1 ELSE 2 END"
_GROUPS = f"SELECT run0, file, group_line, count(*) AS n, arg_min(struct_pack(family := {_FAMILY}, file := file, start_line := start_line, id := id), struct_pack(s := start_line, i := id)) AS first FROM (SELECT *, CAST(run // 100 AS INT) AS run0 FROM ({_ISLANDS}) i) j GROUP BY run0, file, group_line"


def shards(groups: DataFrame, by: str, size: int = SHARD, single: int = ALONE) -> DataFrame:
    """(by, shard, groups, findings): the ordered groups of each run filled one after the other into shards of about equal size, none over size but for a larger group.

    How full the present shard is depends on all before it, so the groups of a run, some hundred numbers, are folded as one
    array; runs are dealt out. Runs of at most single findings are one shard.
    """
    ordered = F.array_sort(F.collect_list(F.struct("first.family", "first.file", "first.start_line", "first.id", "n")))
    rows = groups.groupBy(by).agg(ordered.alias("g"), F.sum("n").alias("total"))
    target = F.ceil(F.col("total") / F.ceil(F.col("total") / size))
    start = F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("count"), F.array().cast("array<int>").alias("all"))

    def fill(s: Column, g: Column) -> Column:
        full = (F.col("total") > single) & (s["count"] > 0) & ((s["count"] >= target) | (s["count"] + g["n"] > size))
        shard = F.when(full, s["shard"] + 1).otherwise(s["shard"])
        return F.struct(shard.alias("shard"), (F.when(full, F.lit(0).cast("long")).otherwise(s["count"]) + g["n"]).alias("count"), F.concat(s["all"], F.array(shard)).alias("all"))

    placed = rows.select(by, F.explode(F.arrays_zip("g", F.aggregate("g", start, fill, lambda s: s["all"]).alias("shard"))).alias("x"))
    return placed.select(by, F.col("x")[placed.schema["x"].dataType.names[1]].alias("shard"), F.col("x.g.n").alias("n")).groupBy(by, "shard").agg(F.count("*").alias("groups"), F.sum("n").alias("findings"))


@REGISTRY.query(
    f", g AS ({_GROUPS}), o AS (SELECT run0, n, row_number() OVER (PARTITION BY run0 ORDER BY first) AS k, sum(n) OVER (PARTITION BY run0) AS total FROM g), "
    f"w AS (SELECT run0, k, 0 AS shard, CAST(n AS BIGINT) AS filled, n FROM o WHERE k = 1 UNION ALL SELECT o.run0, o.k, w.shard + CAST(x.f AS INT), CASE WHEN x.f THEN o.n ELSE w.filled + o.n END, o.n FROM w JOIN o ON o.run0 = w.run0 AND o.k = w.k + 1 "
    f"CROSS JOIN LATERAL (SELECT o.total > {ALONE} AND (w.filled >= ceil(o.total / ceil(o.total / {SHARD})) OR w.filled + o.n > {SHARD}) AS f) x) "
    "SELECT run0, shard, count(*) AS groups, CAST(sum(n) AS BIGINT) AS findings FROM w GROUP BY run0, shard",
    "v_findings",
)
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the raw findings of each year."""
    found = view(spark, sf_dir, "v_findings").where("status = 'raw'")
    named = islands(found).withColumn("run0", F.expr("CAST(run div 100 AS INT)"))
    family = F.create_map(*(F.lit(x) for pair in FAMILY_OF.items() for x in pair))[F.col("category")]
    first = F.min_by(F.struct(family.alias("family"), "file", "start_line", "id"), F.struct("start_line", "id")).alias("first")
    return shards(named.groupBy("run0", "file", "group_line").agg(F.count("*").alias("n"), first), "run0")


@REGISTRY.query(
    f"SELECT file, group_line, row_number() OVER (ORDER BY first) AS place, n FROM (SELECT file, group_line, count(*) AS n, arg_min(struct_pack(family := {_FAMILY}, file := file, start_line := start_line, id := id), struct_pack(s := start_line, i := id)) AS first FROM ({_ISLANDS}) i GROUP BY file, group_line) g",
    "v_findings",
)
def groups_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of findings at one place, by family, file, line and id."""
    groups = grouped_places(view(spark, sf_dir, "v_findings").where("status = 'raw'"))
    return ranked(groups, [F.col("first")], "place").select("file", "group_line", "place", "n")


def distinct_gaps(*sources: DataFrame) -> DataFrame:
    """Gap rows (class, target, check, why, by) of all sources, each row once, as the first source has it."""
    every = [s.withColumn("ord", F.lit(n)) for n, s in enumerate(sources)]
    rows = every[0]
    for s in every[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("class", "target", "check", "why").agg(F.min_by("by", "ord").alias("by"))


_LEDGER_GAPS = "SELECT CAST(class AS STRING) AS class, target, concat('c', CAST(evidence % 3 AS STRING)) AS \"check\", auditor AS why, auditor AS \"by\" FROM v_ledger WHERE status = 'not_assessed'"


@REGISTRY.query(
    f', l AS ({_LEDGER_GAPS}), u AS (SELECT *, 0 AS ord FROM l UNION ALL SELECT CAST(i AS STRING), \'\', \'whole class\', \'no auditor recorded this class: not looked at\', \'coverage\', 1 FROM range(14) t(i) WHERE i NOT IN (SELECT class FROM v_ledger) '
    "UNION ALL SELECT 'all', CAST(count(*) AS STRING), 'entry points with no coverage row', CAST(min(entry) AS STRING), 'coverage', 2 FROM v_entries e WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.target = e.file) HAVING count(*) > 0 "
    "UNION ALL SELECT class, target, \"check\", why, 'older', 3 FROM l) SELECT class, target, \"check\", why, min_by(\"by\", ord) AS \"by\" FROM u GROUP BY class, target, \"check\", why",
    "v_ledger", "v_entries",
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no auditor looked at: rows that say so, classes without rows, entry points without rows, and rows of an older list."""
    ledger = view(spark, sf_dir, "v_ledger")
    said = ledger.where("status = 'not_assessed'").selectExpr("CAST(class AS STRING) AS class", "target", "concat('c', CAST(evidence % 3 AS STRING)) AS check", "auditor AS why", "auditor AS by")
    classes = spark.range(14).select(F.col("id").cast("int").alias("class")).join(ledger, "class", "left_anti")
    classes = classes.select(F.col("class").cast("string"), F.lit("").alias("target"), F.lit("whole class").alias("check"), F.lit("no auditor recorded this class: not looked at").alias("why"), F.lit("coverage").alias("by"))
    bare = view(spark, sf_dir, "v_entries").join(ledger.select(F.col("target").alias("file")), "file", "left_anti").agg(F.count("*").alias("n"), F.min("entry").alias("first")).where("n > 0")
    bare = bare.select(F.lit("all").alias("class"), F.col("n").cast("string").alias("target"), F.lit("entry points with no coverage row").alias("check"), F.col("first").cast("string").alias("why"), F.lit("coverage").alias("by"))
    return distinct_gaps(said, classes, bare, said.withColumn("by", F.lit("older")))


@REGISTRY.query(
    f", l AS ({_LEDGER_GAPS}), i AS (SELECT * FROM (VALUES ('rate', '3'), ('keys', '5'), ('logs', '7')) t(item, class)) SELECT item, target, \"check\", place FROM (SELECT item, target, \"check\", row_number() OVER (PARTITION BY item ORDER BY CASE WHEN \"check\" = 'c0' THEN 1 ELSE 0 END, target, \"check\", why) AS place "
    "FROM i JOIN l ON l.class = i.class OR (i.item = 'logs' AND l.target LIKE '%f39.ts')) x WHERE place <= 3",
    "v_ledger",
)
def checklist_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three gap rows of each item of a production checklist, by class or by pattern, those of a whole class (c0) last."""
    gaps = view(spark, sf_dir, "v_ledger").where("status = 'not_assessed'").selectExpr("CAST(class AS STRING) AS class", "target", "concat('c', CAST(evidence % 3 AS STRING)) AS check", "auditor AS why")
    items = spark.createDataFrame([("rate", "3", None), ("keys", "5", None), ("logs", "7", r"f39\.ts$")], "item string, own string, pattern string")
    met = gaps.join(F.broadcast(items), (F.col("class") == F.col("own")) | F.coalesce(F.expr("target rlike pattern"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.when(F.col("check") == "c0", 1).otherwise(0), "target", "check", "why"))
    return met.withColumn("place", place).where("place <= 3").select("item", "target", "check", "place")


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
