"""What changed between runs: matching findings one to one, classes of a diff, and what an incremental run audits again or carries over."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import FILE_NAMES, line_gap, plain_title
from ..plans.checkpoints import checkpointed
from ..plans.registry import Registry
from ..plans.views import view
from .coverage import closure

REGISTRY = Registry()
#: Lines within which two findings may be the same, the share of words of titles that are alike, and the share of targets above which a run is a full one.
LINE_WINDOW, ALIKE, FULL_ABOVE = 3, 0.6, 0.5
#: Lines of the blocks in which places meet.
LINE_BLOCK = 16
#: Findings of one category and file, and titles of one category, that are compared within one task, and findings to such a title; where there are more, kinds are joined.
CELL_ROWS, ROWS_TITLE = 8192, 32


def greedy_pairs(members: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (c, p) that a greedy choice by (rank, c, p) makes, each c and each p in one at most.

    members (c, kind) are findings of a kind that ranks all others alike; lists (kind, n, p, rank) are what a kind looks at, from 0 on in the order of
    (rank, p). A member offers itself to one of its list, which takes the best by (rank, c); who isn't taken goes on to the
    next. Of one kind the later members always stand further down than the earlier ones, so they begin where they are themselves, and a
    thousand equal findings take one step. The steps end when all offers are taken.
    """
    first = F.row_number().over(Window.partitionBy("kind").orderBy("c")) - 1
    state = members.withColumn("j", first).withColumn("n", F.col("j"))
    so_far = Window.partitionBy("kind").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = checkpointed(lists)
    while True:
        offers = checkpointed(state.join(lists, ["kind", "n"]))
        best = offers.groupBy("p").agg(F.min(F.struct("rank", "c")).alias("best"))
        judged = offers.join(best, "p").withColumn("taken", F.col("best.c") == F.col("c"))
        state = checkpointed(judged.select("c", "p", "kind", "j", "taken", "n"))
        if not state.where("NOT taken").limit(1).count():
            return state.select("c", "p")
        moved = state.withColumn("n", F.col("n") + F.when(F.col("taken"), 0).otherwise(1))
        state = moved.select("c", "kind", "j", (F.col("j") + F.max(F.col("n") - F.col("j")).over(so_far)).alias("n"))


def alike_titles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category, title, other) of plain titles of a and b (category, title) of one category that are equal or share 0.6 of their words.

    Two such sets share one of the n - ceil(0.6 n) + 1 rarest words of each, so only these meet.
    """
    both = a.unionByName(b).distinct().where("title <> ''").withColumn("words", F.array_distinct(F.split("title", " ")))
    seen = both.select("category", "title", F.explode("words").alias("word"))
    rare = seen.groupBy("category", "word").agg(F.count("*").alias("often"))
    ranked = seen.join(rare, ["category", "word"]).groupBy("category", "title").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("of"))
    least = F.size("of") - F.ceil(F.size("of") * ALIKE - 1e-9).cast("int") + 1
    keys = checkpointed(ranked.select("category", "title", F.explode(F.transform(F.slice("of", F.lit(1), least), lambda x: x["word"])).alias("word")))
    mine, theirs = (keys.join(side.distinct(), ["category", "title"], "left_semi") for side in (a, b))
    met = mine.join(theirs.withColumnRenamed("title", "other"), ["category", "word"]).select("category", "title", "other").distinct()
    # words are told once a title, not once a pair
    numbered = checkpointed(both.select("category", "title", "words"))
    sides = [numbered.select("category", F.col("title").alias(t), F.col("words").alias(w)) for t, w in (("title", "x"), ("other", "y"))]
    shared = F.size(F.array_intersect("x", "y"))
    counted = met.join(sides[0], ["category", "title"]).join(sides[1], ["category", "other"]).withColumn("shared", shared)
    return counted.where((F.col("title") == F.col("other")) | (F.col("shared") / (F.size("x") + F.size("y") - F.col("shared")) >= ALIKE)).select("category", "title", "other")


def _cell(cell: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """c and p of a cell in order of id, the numbers of their titles among each other, and which titles of c are like which of p."""
    c, p = (cell[cell["side"] == side].sort_values("id") for side in ("c", "p"))
    (mine, titles), (theirs, others) = (pd.factorize(side["title"]) for side in (c, p))
    place: dict[str, int] = {}
    words = [[place.setdefault(w, len(place)) for w in set(t.split(" ")) - {""}] for t in [*titles, *others]]
    held = np.zeros((len(words), len(place) + 1), np.float32)
    for i, of in enumerate(words):
        held[i, of] = 1
    size = held.sum(axis=1)
    shared = held[: len(titles)] @ held[len(titles) :].T
    return c, p, mine, theirs, (shared > 0) & (shared >= ALIKE * (size[: len(titles), None] + size[None, len(titles) :] - shared) - 1e-3)


def _pairs(c: pd.DataFrame, p: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"c": c["id"].to_numpy()[i], "p": p["id"].to_numpy()[j]})


def matched_titles(cell: pd.DataFrame) -> pd.DataFrame:
    """(c, p): the last pass of match_findings over the findings of one category (side, id, title)."""
    c, p, mine, theirs, alike = _cell(cell)
    # what is left of each title of p, the next one first
    queues = [np.flatnonzero(theirs == t).tolist()[::-1] for t in range(alike.shape[1])]
    heads, near = np.array([q[-1] for q in queues], np.int64), [np.flatnonzero(row) for row in alike]
    pairs = []
    for i, t in enumerate(mine.tolist()):
        if len(near[t]) and (j := heads[near[t]].min()) < len(p):
            pairs.append((i, j))
            of = queues[theirs[j]]
            of.pop()
            heads[theirs[j]] = of[-1] if of else len(p)
    return _pairs(c, p, pairs)


def matched_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """(c, p): the first two passes of match_findings over the findings of one category and file (side, id, start_line, end_line, title)."""
    c, p, mine, theirs, alike = _cell(cell)
    # places as numbers, those without a line by themselves
    start, end = ([side[k].to_numpy("float64", na_value=np.nan) for side in (c, p)] for k in ("start_line", "end_line"))
    ranks, ones, others, pairs = [], [], [], []
    free_c, free_p = np.ones(len(c), bool), np.ones(len(p), bool)
    for i in range(len(c)):
        gap = np.maximum(0, np.maximum(start[1] - end[0][i], start[0][i] - end[1])) if not np.isnan(start[0][i]) else np.where(np.isnan(start[1]), 0.0, np.nan)
        at = np.flatnonzero(gap <= LINE_WINDOW).astype(np.int32)
        ranks.append((gap[at] * 2 + ~alike[mine[i], theirs[at]]).astype(np.int8))
        ones.append(np.full(len(at), i, np.int32))
        others.append(at)
    ranks, ones, others = map(np.concatenate, (ranks, ones, others))
    for rank in range(2 * LINE_WINDOW + 2):
        found = np.flatnonzero(ranks == rank)
        for first in range(0, len(found), 1 << 16):
            some = found[first : first + (1 << 16)]
            some = some[free_c[ones[some]] & free_p[others[some]]]
            for i, j in zip(ones[some].tolist(), others[some].tolist(), strict=True):
                if free_c[i] and free_p[j]:
                    free_c[i] = free_p[j] = False
                    pairs.append((i, j))
    for i in np.flatnonzero(free_c):
        left = np.flatnonzero(free_p & alike[mine[i], theirs])
        if len(left):
            free_p[left[0]] = False
            pairs.append((i, left[0]))
    return _pairs(c, p, pairs)


def match_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(c, p): ids of current and previous findings (id, category, file, start_line, end_line, title) that are the same.

    Three passes of a greedy choice: the same file within LINE_WINDOW lines, the nearest first and equal titles before others;
    the same file and title; the same title. Only findings of one category can be the same. Findings without file or
    lines are matched by title, or where neither has a line; one without a last line has one line. The first two passes are made file by file and the last one category by
    category, each in a task of its own up to CELL_ROWS. Where there are more, findings that are alike in all these are one kind, and kinds
    meet instead of findings: near ones by blocks of lines, titles by their rarest words. Empty tables match nothing; ids have to be unique.
    """
    place = ["file", "start_line", "end_line"]
    side = lambda df: checkpointed(df.select("id", "category", "file", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), plain_title(F.col("title")).alias("title")))
    c, p = side(current), side(previous)
    kind = c.schema["id"].dataType.simpleString()
    pairs = []

    def left(now: DataFrame) -> tuple[DataFrame, ...]:
        pairs.append(now)
        return tuple(checkpointed(df.join(now.select(F.col(k).alias("id")), "id", "left_anti")) for df, k in ((c, "c"), (p, "p")))

    def by_cells(keys: list[str], size: Column, most: int, matched: Callable) -> tuple[DataFrame, DataFrame]:
        """The pairs of cells that one task takes, and the keys of the others."""
        both = c.withColumn("side", F.lit("c")).unionByName(p.withColumn("side", F.lit("p"))).where("category IS NOT NULL AND file <> ''" if "file" in keys else "category IS NOT NULL")
        held = both.groupBy(keys).agg(F.count_if(F.col("side") == "c").alias("n"), F.count_if(F.col("side") == "p").alias("m"), size.alias("size")).where("n > 0 AND m > 0")
        cells = checkpointed(held.select(*keys, ((F.col("size") <= CELL_ROWS) & (F.col("n") + F.col("m") <= most)).alias("fits")))
        fitting = both.join(cells.where("fits"), keys, "left_semi")
        return checkpointed(fitting.groupBy(keys).applyInPandas(matched, f"c {kind}, p {kind}")), cells.where("NOT fits").select(keys)

    def by_kinds(of: list[str], met: Callable, crowded: DataFrame) -> DataFrame:
        kinds = ["category", *of]
        some_c, some_p = (df.join(crowded, crowded.columns, "left_semi") for df in (c, p))
        mine, theirs = (df.select(kinds).distinct() for df in (some_c, some_p))
        titles = checkpointed(alike_titles(some_c.select("category", "title"), some_p.select("category", "title")))
        ranked = met(mine.withColumn("kind", F.to_json(F.struct(*kinds))), theirs.withColumn("other_kind", F.to_json(F.struct(*kinds))), titles).select("kind", "other_kind", "rank")
        held = some_p.select(F.col("id").alias("p"), F.to_json(F.struct(*kinds)).alias("other_kind"))
        n = F.row_number().over(Window.partitionBy("kind").orderBy("rank", "p")) - 1
        lists = ranked.join(held, "other_kind").withColumn("n", n).select("kind", "n", "p", "rank")
        return greedy_pairs(some_c.select(F.col("id").alias("c"), F.to_json(F.struct(*kinds)).alias("kind")), lists)

    now, crowded = by_cells(["category", "file"], F.lit(0), CELL_ROWS, matched_cell)
    c, p = left(now)
    if crowded.limit(1).count():
        c, p = left(by_kinds([*place, "title"], _near, crowded))
        c, p = left(by_kinds(["file", "title"], _same_file, crowded))
    now, crowded = by_cells(["category"], F.count_distinct("title"), CELL_ROWS * ROWS_TITLE, matched_titles)
    pairs.append(now)
    if crowded.limit(1).count():
        pairs.append(by_kinds(["title"], _same_title, crowded))
    return reduce(DataFrame.unionByName, pairs)


def _near(a: DataFrame, b: DataFrame, titles: DataFrame) -> DataFrame:
    """Kinds within LINE_WINDOW lines of one file, or both without a line; they meet in blocks of lines."""
    blocks = lambda lo, hi: F.explode(F.when(lo.isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.floor(lo / LINE_BLOCK), F.floor(F.greatest(lo, hi) / LINE_BLOCK))))
    start, end = F.col("start_line"), F.coalesce("end_line", "start_line")
    mine = a.withColumn("block", blocks(start - LINE_WINDOW, end + LINE_WINDOW))
    theirs = b.withColumn("block", blocks(start, end)).select("category", "file", "block", "other_kind", F.col("title").alias("other"), start.alias("from"), F.col("end_line").alias("to"))
    gap = line_gap(start, F.col("end_line"), F.col("from"), F.col("to"))
    near = mine.join(theirs, ["category", "file", "block"]).withColumn("gap", gap).where(F.col("gap") <= LINE_WINDOW).select("category", "kind", "other_kind", "title", "other", "gap").distinct()
    alike = titles.withColumn("alike", F.lit(True))
    return near.join(alike, ["category", "title", "other"], "left").withColumn("rank", (F.col("gap") * 2 + F.when(F.col("alike"), 0).otherwise(1)).cast("int"))


def _same_file(a: DataFrame, b: DataFrame, titles: DataFrame) -> DataFrame:
    theirs = b.select("category", "file", F.col("title").alias("other"), "other_kind")
    return a.join(titles, ["category", "title"]).join(theirs, ["category", "file", "other"]).withColumn("rank", F.lit(0))


def _same_title(a: DataFrame, b: DataFrame, titles: DataFrame) -> DataFrame:
    theirs = b.select("category", F.col("title").alias("other"), "other_kind")
    return a.join(titles, ["category", "title"]).join(theirs, ["category", "other"]).withColumn("rank", F.lit(0))


def classify(current: DataFrame, previous: DataFrame, older: list[DataFrame], partial: bool = False, previous_partial: bool = False) -> DataFrame:
    """(id, class, was): new, fixed, regressed, unchanged, not_rechecked or still_fixed for each current finding and each previous one that is gone.

    All tables have id, category, severity, file, start_line, end_line, title, fixed; older runs go from the newest on. A
    finding marked fixed that comes back is regressed, as is one that an older run had and the previous one, if it
    looked everywhere, had not. severity_changed rows come besides.
    """
    pairs = checkpointed(match_findings(current, previous))
    state = lambda df, k: df.select(F.col("id").alias(k), F.col("fixed").alias(f"{k}_fixed"), F.col("severity").alias(f"{k}_severity"))
    both = pairs.join(state(current, "c"), "c").join(state(previous, "p"), "p")
    kind = F.when(F.col("c_fixed") & F.col("p_fixed"), "still_fixed").when(F.col("c_fixed"), "fixed").when(F.col("p_fixed"), "regressed").otherwise("unchanged")
    rows = [both.select(F.col("c").alias("id"), kind.alias("class"), F.col("p").alias("was"))]
    changed = both.where("NOT c_fixed AND c_severity <> p_severity")
    rows.append(changed.select(F.col("c").alias("id"), F.lit("severity_changed").alias("class"), F.col("p").alias("was")))
    fresh = current.join(pairs.select(F.col("c").alias("id")), "id", "left_anti")
    rest = fresh.where("NOT fixed")
    for run in older if not previous_partial else []:
        again = checkpointed(match_findings(rest, run))
        rows.append(again.select(F.col("c").alias("id"), F.lit("regressed").alias("class"), F.col("p").alias("was")))
        rest = rest.join(again.select(F.col("c").alias("id")), "id", "left_anti")
    for new in (rest, fresh.where("fixed")):
        rows.append(new.select("id", F.lit("new").alias("class"), F.lit(None).cast("long").alias("was")))
    gone = previous.join(pairs.select(F.col("p").alias("id")), "id", "left_anti")
    how = F.when(F.col("fixed"), "still_fixed").when(F.lit(partial), "not_rechecked").otherwise("fixed")
    rows.append(gone.select(F.lit(None).cast("long").alias("id"), how.alias("class"), F.col("id").alias("was")))
    return reduce(DataFrame.unionByName, rows)


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three runs of findings, from the newest on: orders by their key, with files and lines that mostly stay."""
    rows = view(spark, sf_dir, "v_findings").selectExpr(
        "id", "id % 3 AS run_no", "concat('c', CAST(id div 3 % 14 AS STRING)) AS category", "severity", "concat('src/f', CAST(id div 3 % 397 AS STRING), '.ts') AS file",
        "IF(id % 13 = 0, NULL, CAST(id div 3 * 7 % 400 + id % 5 AS INT)) AS start_line", "IF(id % 13 = 0, NULL, CAST(id div 3 * 7 % 400 + id % 5 + 2 AS INT)) AS end_line",
        "concat('Missing check ', element_at(array('alpha', 'beta', 'gamma', 'delta', 'epsilon'), CAST(id div 3 % 5 + 1 AS INT)), ' in handler ', translate(CAST(id div 3 % 97 AS STRING), '0123456789', 'qwertyuiop')) AS title", "id % 11 = 0 AS fixed",
    )
    return [rows.where(f"run_no = {n}").drop("run_no") for n in (2, 1, 0)]


_PLAIN = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '`[^`]*`', ' ', 'g'), '{FILE_NAMES}', ' ', 'g'), '[^a-z]+', ' ', 'g'))"
_RUNS = (
    ", runs AS (SELECT id, id % 3 AS run_no, concat('c', CAST(id // 3 % 14 AS VARCHAR)) AS category, severity, concat('src/f', CAST(id // 3 % 397 AS VARCHAR), '.ts') AS file, CASE WHEN id % 13 <> 0 THEN id // 3 * 7 % 400 + id % 5 END AS start_line, "
    "CASE WHEN id % 13 <> 0 THEN id // 3 * 7 % 400 + id % 5 + 2 END AS end_line, concat('Missing check ', (['alpha', 'beta', 'gamma', 'delta', 'epsilon'])[id // 3 % 5 + 1], ' in handler ', translate(CAST(id // 3 % 97 AS VARCHAR), '0123456789', 'qwertyuiop')) AS title, id % 11 = 0 AS fixed FROM v_findings), "
    f"t AS (SELECT *, {_PLAIN} AS plain, string_split({_PLAIN}, ' ') AS words FROM runs), w AS (SELECT DISTINCT category, plain, words FROM t WHERE plain <> ''), "
    f"alike AS (SELECT DISTINCT a.category, a.plain AS x, b.plain AS y FROM w a JOIN w b ON a.category = b.category AND (a.plain = b.plain OR len(list_intersect(list_distinct(a.words), list_distinct(b.words))) / len(list_distinct(list_concat(a.words, b.words))) >= {ALIKE}))"
)
_GAP = "CASE WHEN c.start_line IS NULL AND p.start_line IS NULL THEN 0 WHEN c.start_line IS NULL OR p.start_line IS NULL THEN NULL ELSE greatest(0, p.start_line - c.end_line, c.start_line - p.end_line) END"


def _matched(name: str, current: str, previous: str) -> str:
    """Tables of SQL that end in name(c, p): in each step of a pass the pairs go that are the first ones of both their ends."""
    out, c, p = "", current, previous
    passes = [
        f"SELECT c, p, gap * 2 + CASE WHEN x IS NULL THEN 1 ELSE 0 END AS rank FROM (SELECT c.id AS c, p.id AS p, {_GAP} AS gap, alike.x FROM {{c}} c JOIN {{p}} p ON c.category = p.category AND c.file = p.file LEFT JOIN alike ON alike.category = c.category AND x = c.plain AND y = p.plain) WHERE gap <= {LINE_WINDOW}",
        "SELECT c.id AS c, p.id AS p, 0 AS rank FROM {c} c JOIN {p} p ON c.category = p.category AND c.file = p.file JOIN alike ON alike.category = c.category AND x = c.plain AND y = p.plain",
        "SELECT c.id AS c, p.id AS p, 0 AS rank FROM {c} c JOIN alike ON alike.category = c.category AND x = c.plain JOIN {p} p ON c.category = p.category AND y = p.plain",
    ]
    best = lambda of, by="": f"SELECT *, row_number() OVER (PARTITION BY {by}c ORDER BY rank, c, p) = 1 AND row_number() OVER (PARTITION BY {by}p ORDER BY rank, c, p) = 1 AS best FROM {of}"
    for k, found in enumerate(passes):
        step = f"{name}_{k}"
        out += f", {step}_r(n, c, p, rank) AS (SELECT 0, c, p, rank FROM ({found.format(c=c, p=p)}) UNION ALL SELECT n + 1, c, p, rank FROM (SELECT *, bool_or(best) OVER (PARTITION BY c) AS of_c, bool_or(best) OVER (PARTITION BY p) AS of_p FROM ({best(step + '_r')})) WHERE NOT of_c AND NOT of_p)"
        out += f", {step} AS (SELECT c, p FROM ({best(step + '_r', 'n, ')}) WHERE best)"
        out += f", {step}_c AS (SELECT * FROM {c} WHERE id NOT IN (SELECT c FROM {step})), {step}_p AS (SELECT * FROM {p} WHERE id NOT IN (SELECT p FROM {step}))"
        c, p = f"{step}_c", f"{step}_p"
    return out + f", {name} AS ({' UNION ALL '.join(f'SELECT c, p FROM {name}_{k}' for k in range(len(passes)))})"


_THREE = _RUNS + ", cur AS (SELECT * FROM t WHERE run_no = 2), prev AS (SELECT * FROM t WHERE run_no = 1), old AS (SELECT * FROM t WHERE run_no = 0)" + _matched("m", "cur", "prev")
_CLASSES = _THREE + ", rest AS (SELECT * FROM cur WHERE NOT fixed AND id NOT IN (SELECT c FROM m))" + _matched("again", "rest", "old") + """, classes AS (
  SELECT m.c AS id, CASE WHEN c.fixed AND p.fixed THEN 'still_fixed' WHEN c.fixed THEN 'fixed' WHEN p.fixed THEN 'regressed' ELSE 'unchanged' END AS class, m.p AS was FROM m JOIN cur c ON c.id = m.c JOIN prev p ON p.id = m.p
  UNION ALL SELECT m.c, 'severity_changed', m.p FROM m JOIN cur c ON c.id = m.c JOIN prev p ON p.id = m.p WHERE NOT c.fixed AND c.severity <> p.severity
  UNION ALL SELECT c, 'regressed', p FROM again
  UNION ALL SELECT id, 'new', NULL FROM cur WHERE id NOT IN (SELECT c FROM m) AND id NOT IN (SELECT c FROM again)
  UNION ALL SELECT NULL, CASE WHEN fixed THEN 'still_fixed' ELSE 'fixed' END, id FROM prev WHERE id NOT IN (SELECT p FROM m))"""


@REGISTRY.query(_THREE + " SELECT c, p FROM m", "v_findings")
def matched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the newest run and those of the one before that are the same."""
    current, previous, _ = _runs(spark, sf_dir)
    return match_findings(current, previous)


@REGISTRY.query(_CLASSES + " SELECT * FROM classes", "v_findings")
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of three runs against the others."""
    current, previous, older = _runs(spark, sf_dir)
    return classify(current, previous, [older])


@REGISTRY.query(_CLASSES + " SELECT class, count(*) AS n FROM classes GROUP BY class", "v_findings")
def diff_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings are new, fixed, regressed, unchanged and so on."""
    return audit_diff(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


_CHANGED = "SELECT CAST(i AS BIGINT) AS node FROM range(31, 94, 31) t(i)"


def _affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(view(spark, sf_dir, "v_edges").where("src % 7 <> 0"), spark.range(31, 94, 31).select(F.col("id").alias("node")))


_SOME = f", r AS ({_CHANGED} UNION SELECT e.src FROM v_edges e JOIN r ON e.dst = r.node WHERE e.src % 7 <> 0)"


@REGISTRY.query(_SOME + " SELECT node FROM r", "v_edges")
def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a change of three reaches over imports, in several steps and round cycles."""
    return _affected(spark, sf_dir)


@REGISTRY.query(_SOME + " SELECT entry, file FROM v_entries WHERE entry % 1500 IN (SELECT node FROM r)", "v_edges", "v_entries")
def reaudit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points in files that a change reaches."""
    reached = _affected(spark, sf_dir)
    return view(spark, sf_dir, "v_entries").join(reached, F.expr("entry % 1500") == F.col("node"), "left_semi").select("entry", "file")


def plan(targets: DataFrame, reached: DataFrame, global_change: Column, full_above: float = FULL_ABOVE) -> DataFrame:
    """total, reaudit, mode, reason of targets (node, ...): full where a global file changed or more than full_above of the targets are reached, else incremental."""
    hit = targets.join(reached.withColumn("hit", F.lit(True)), "node", "left")
    counted = hit.agg(F.count("*").alias("total"), F.count_if(F.coalesce("hit", F.lit(False))).alias("reaudit"))
    much = F.col("reaudit") > F.col("total") * full_above
    reason = F.when(global_change, "global file").when(much, "most targets").otherwise("")
    return counted.select("total", "reaudit", F.when(reason == "", "incremental").otherwise("full").alias("mode"), reason.alias("reason"))


@REGISTRY.query(
    _SOME + " SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS reaudit, CASE WHEN count(*) FILTER (WHERE hit) > count(*) * 0.5 THEN 'full' ELSE 'incremental' END AS mode, "
    "CASE WHEN count(*) FILTER (WHERE hit) > count(*) * 0.5 THEN 'most targets' ELSE '' END AS reason FROM (SELECT entry % 1500 IN (SELECT node FROM r) AS hit FROM v_entries) x",
    "v_edges", "v_entries",
)
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a change of three files asks for a full audit."""
    targets = view(spark, sf_dir, "v_entries").select(F.expr("entry % 1500").alias("node"))
    return plan(targets, _affected(spark, sf_dir), F.lit(False))


_ITEMS = "id, CASE WHEN id % 10 < 3 THEN id + 1 WHEN id % 10 = 5 THEN id - 7 END AS needs, id % 23 = 0 AS cites_changed, CASE id % 10 WHEN 5 THEN 'chain' ELSE 'finding' END AS kind"


def carried(items: DataFrame) -> DataFrame:
    """items (id, needs, cites_changed) that can be carried over: nothing they cite changed, and what they need (a finding they repeat or build on) is carried or not among the items that go.

    Steps drop the items that need one dropped before, until none is left to drop.
    """
    links = items.where("needs IS NOT NULL").select(F.col("id").alias("src"), F.col("needs").alias("dst"))
    gone = closure(links, items.where("cites_changed").select(F.col("id").alias("node")))
    return items.join(gone.select(F.col("node").alias("id")), "id", "left_anti")


@REGISTRY.query(f", i AS (SELECT {_ITEMS} FROM v_findings), g AS (SELECT id FROM i WHERE cites_changed UNION SELECT i.id FROM i JOIN g ON i.needs = g.id) SELECT id, kind FROM i WHERE id NOT IN (SELECT id FROM g)", "v_findings")
def carried_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings carried over: dropping one drops its duplicates and the chains built on it."""
    items = view(spark, sf_dir, "v_findings").selectExpr(*_split(_ITEMS))
    return carried(items).select("id", "kind")


def _split(columns: str) -> list[str]:
    return ["id", columns.split(", ", 1)[1].split(" AS needs")[0] + " AS needs", "id % 23 = 0 AS cites_changed", "CASE id % 10 WHEN 5 THEN 'chain' ELSE 'finding' END AS kind"]


@REGISTRY.query(
    ", f AS (SELECT id FROM v_findings WHERE id % 4 <> 0), e AS (SELECT class, target, evidence, CASE WHEN evidence % 5 = 0 THEN 'abc1234' END AS origin FROM v_ledger WHERE CAST(regexp_extract(target, '\\d+') AS INT) % 9 <> 0) "
    "SELECT class, target, evidence, coalesce(origin, 'def5678') AS carried_from FROM e WHERE evidence % 2 = 1 OR evidence IN (SELECT id FROM f)",
    "v_findings", "v_ledger",
)
def carried_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows whose target is untouched and whose evidence is untouched or carried, stamped with this commit unless an older one stands there."""
    kept = view(spark, sf_dir, "v_findings").where("id % 4 <> 0").select(F.col("id").alias("evidence"))
    touched = view(spark, sf_dir, "v_ledger").select("target").distinct().where(F.regexp_extract("target", r"\d+", 0).cast("int") % 9 == 0)
    rows = view(spark, sf_dir, "v_ledger").join(touched, "target", "left_anti")
    evidence = rows.where("evidence % 2 = 1").unionByName(rows.where("evidence % 2 = 0").join(kept, "evidence", "left_semi").select(rows.columns))
    origin = F.when(F.col("evidence") % 5 == 0, "abc1234")
    return evidence.select("class", "target", "evidence", F.coalesce(origin, F.lit("def5678")).alias("carried_from"))


@REGISTRY.query(
    ", b AS (SELECT path FROM v_paths WHERE key % 5 <> 0), a AS (SELECT path FROM v_paths WHERE key % 7 <> 0) SELECT 'added' AS what, path FROM (SELECT path FROM a EXCEPT SELECT path FROM b) UNION ALL SELECT 'gone', path FROM (SELECT path FROM b EXCEPT SELECT path FROM a)",
    "v_paths",
)
def workspace_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a status that came or went between two looks."""
    paths = view(spark, sf_dir, "v_paths")
    before, after = paths.where("key % 5 <> 0").select("path"), paths.where("key % 7 <> 0").select("path")
    named = lambda df, what: df.select(F.lit(what).alias("what"), "path")
    return named(after.subtract(before), "added").unionByName(named(before.subtract(after), "gone"))


@REGISTRY.query("SELECT DISTINCT path FROM v_paths WHERE (key % 5 = 0 OR key % 7 = 0 OR key % 11 = 0) AND NOT starts_with(path, 'supabase/')", "v_paths")
def changed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files changed since a commit, since the last run or not committed yet, without a directory that doesn't count."""
    paths = view(spark, sf_dir, "v_paths")
    some = [paths.where(f"key % {n} = 0").select("path") for n in (5, 7, 11)]
    return some[0].union(some[1]).union(some[2]).distinct().where(~F.col("path").startswith("supabase/"))


@REGISTRY.query(
    ", f AS (SELECT DISTINCT path FROM v_paths), c AS (SELECT key, regexp_replace(path, '^([^/]+/)', '') AS cited FROM v_paths WHERE key % 3 = 0), h AS (SELECT c.key, c.cited, f.path, f.path = c.cited AS exact FROM c JOIN f ON f.path = c.cited OR ends_with(f.path, '/' || c.cited)) "
    "SELECT key, CASE WHEN bool_or(exact) THEN max(cited) ELSE max(path) END AS path FROM h GROUP BY key HAVING bool_or(exact) OR count(*) = 1",
    "v_paths",
)
def cited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of the tree a cited path names: itself, or else the only one that ends with it; endings of several files name none."""
    tree = view(spark, sf_dir, "v_paths").select("path").distinct()
    parts = F.split("path", "/")
    ends = tree.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("cited"))
    cites = view(spark, sf_dir, "v_paths").where("key % 3 = 0").select("key", F.regexp_replace("path", r"^([^/]+/)", "").alias("cited"))
    met = cites.join(ends, "cited").groupBy("key", "cited").agg(F.max((F.col("path") == F.col("cited")).cast("int")).alias("exact"), F.count("*").alias("n"), F.max("path").alias("only"))
    return met.where("exact = 1 OR n = 1").select("key", F.when(F.col("exact") == 1, F.col("cited")).otherwise(F.col("only")).alias("path"))


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
