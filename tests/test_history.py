from pyspark.sql import functions as F

from assayer.operators import history

TABLE = "name string, text string"


def test_archive_replace_and_read(spark, tmp_path):
    folder = str(tmp_path / "history")
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, title string")
    when = "2024-10-01T09-00-00"
    assert history.archived(spark, folder).count() == 0
    names = [history.archive(rows(i), folder, when) for i in range(3)] + [history.archive(rows(9), folder, "2024-09-30T23-59-59")]
    assert names == [when, f"{when}-2", f"{when}-3", "2024-09-30T23-59-59"]
    for _ in range(2):
        history.replace(rows(20, 21), folder, f"{when}-2")
    got = sorted((r.run, r.id) for r in spark.read.parquet(folder).collect())
    assert got == [("2024-09-30T23-59-59", 9), (when, 0), (f"{when}-2", 20), (f"{when}-2", 21), (f"{when}-3", 2)]


def test_order_of_runs(spark):
    names = ["2026-10-01T09-00-00", "2026-10-01T09-00-00-2", "2026-10-01T09-00-00-10", "2026-09-30T23-59-59"]
    runs = spark.createDataFrame([(n, True) for n in names] + [("2026-11-01T00-00-00", False), ("2026-12-01T00-00-00", None)], "name string, report boolean")
    assert [r.name for r in history.finished(runs).orderBy(F.desc("key")).collect()] == [names[2], names[1], names[0], names[3]]
    assert history.free_name(runs, "2026-10-01T09-00-00") == "2026-10-01T09-00-00-11" and history.free_name(runs.limit(0), "x") == "x"


def test_snapshots(spark):
    rows = [("a", "auth", "high", "t", "verified", "fixed", "f.ts", 1, 2), ("b", "auth", None, None, "fixed", None, None, None, None), ("c", "x", "LOW", "t", "rejected", None, "f", 1, 1), ("d", "x", "LOW", "t", None, None, "f", 1, 1)]
    df = spark.createDataFrame(rows, "id string, category string, severity string, title string, status string, remediation string, file string, start_line int, end_line int")
    assert sorted(tuple(r) for r in history.snapshot(df).collect()) == [("a", "auth", "HIGH", "t", "f.ts", 1, 2, True), ("b", "auth", "", "b", "", None, None, True)]


def test_why_a_run_cannot_stand_in(spark):
    rows = [("0", None, True, "c", None, 1, 1), ("1", True, False, "c", None, 1, 1), ("2", True, True, "", None, 1, 1), ("3", True, True, "c", "top5", 1, 1), ("4", True, True, "c", "", 0, None), ("5", True, True, "c", None, 0, 1), ("6", False, False, None, "s", 0, 0)]
    got = {r.name: (r.ok, r.reason) for r in history.stand_in(spark.createDataFrame(rows, "name string, there boolean, report boolean, commit string, scope string, findings int, non_issues int")).collect()}
    assert [got[str(n)][0] for n in range(7)] == [False] * 5 + [True, False]
    reasons = list(history.REASONS.values())
    assert [got[str(n)][1] for n in (0, 1, 2, 4, 5, 6)] == [reasons[0], reasons[1], reasons[2], reasons[4], None, reasons[0]] and 'scope "top5"' in got["3"][1]


def test_gaps_are_replaced_not_added(spark):
    old = "# Gaps\n\n| Category | Check | Why not assessed |\n|---|---|---|\n| auth | by hand | no time |\n| injection | semgrep | failed (prepass) |\n| Stack profile | x | y (prepass) |\n| other | tool of theirs | z (prepass) |\n"
    docs = spark.createDataFrame([("a", old), ("b", None), ("c", "just text\n"), ("d", old)], TABLE)
    rows = spark.createDataFrame([(n, i, f"| injection | semgrep | not run {i} (prepass) |") for n in "abc" for i in (2, 1)], "name string, n int, line string")
    once = history.merged_gaps(docs, rows, ["semgrep", "bandit"])
    got = {r.name: r.text for r in once.collect()}
    new = "| injection | semgrep | not run 1 (prepass) |\n| injection | semgrep | not run 2 (prepass) |\n"
    kept = "# Gaps\n\n| Category | Check | Why not assessed |\n|---|---|---|\n| auth | by hand | no time |\n| other | tool of theirs | z (prepass) |\n"
    assert got == {"a": kept + new, "b": f"{history.GAP_HEAD}\n{new}", "c": f"{history.GAP_HEAD}\njust text\n{new}", "d": kept}
    assert {r.name: r.text for r in history.merged_gaps(once, rows, ["semgrep", "bandit"]).collect()} == got
