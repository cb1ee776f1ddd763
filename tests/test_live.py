import json

import pytest
from pyspark.sql import functions as F

from assayer.streaming import live

LEDGER = json.dumps({"entries": [{"class": "auth"}, {"class": "config"}]})


def stream(spark, folder, rows, schema):
    """Each row list as one file of a stream, so that they come in several batches."""
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}/in/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")


def collected(df, folder):
    name = f"t{abs(hash(str(folder)))}"
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_half_written_ledgers_keep_their_rows(spark, tmp_path):
    looks = [[(1, "a", 9, LEDGER), (1, "b", 3, "{")], [(2, "a", 9, "unread"), (2, "b", 9, LEDGER)], [(3, "a", 12, LEDGER[:-4]), (3, "b", None, None)], [(4, "a", 2, '{"entries": []}'), (4, None, 1, "")]]
    got = collected(live.ledger_rows(stream(spark, tmp_path, looks, live.LISTING)), tmp_path)
    assert got == [("a", 1, 2, True), ("a", 2, 2, False), ("a", 3, 2, True), ("a", 4, 0, True), ("b", 1, 0, True), ("b", 2, 2, True), ("b", 3, 0, False)]


def test_changes_after_the_baseline(spark, tmp_path):
    looks = [[(1, "a", 5, ""), (2, "a", 5, "")], [(3, "a", 6, "")], [(4, "a", 6, ""), (5, "b", 1, "")]]
    assert collected(live.changes(stream(spark, tmp_path, looks, live.LISTING)), tmp_path) == [("a", 3, 6)]


def test_sessions(spark, tmp_path):
    events = [[("s", 1, "check"), ("s", 2, "start")], [("s", 3, "check"), ("t", 3, "end")], [("s", 4, "end"), ("s", 5, "check"), ("s", 6, "other")]]
    got = collected(live.sessions(stream(spark, tmp_path, events, "session string, tick long, event string")), tmp_path)
    assert [r[2] for r in got] == ["free", "marked", "guarded", "ended", "free", "ignored", "free"]


def test_each_finding_is_announced_once_and_the_backlog_never(spark, tmp_path):
    heard, sampled = [], []
    rows = [[("f1",), ("f2",)], [("f2",), ("f3",)], [("f3",), ("f4",), ("f4",)]]
    query = live.announce(stream(spark, tmp_path, rows, "id string"), lambda df, n: heard.extend((n, r.id) for r in df.collect()), f"{tmp_path}/ck", sampled.append, once=True)
    query.awaitTermination(120)
    assert sorted(x for _, x in heard) == ["f3", "f4"] and sampled == [0]


@pytest.mark.parametrize("files,raw,found,want", [([], 0, 0, "Pre-pass"), (["prepass.md"], 0, 0, "Recon"), (["recon.md"], 0, 0, "Audit"), (["recon.md"], 2, 2, "Audit"), (["recon.md"], 1, 2, "Verification"), (["recon.md"], 0, 2, "Test quality"), (["recon.md", "test-quality.md"], 0, 2, "Report"), (["report.html"], 0, 0, "Done")])
def test_phase(spark, files, raw, found, want):
    got = spark.range(1).select(live.phase(lambda name: F.lit(name in files), F.lit(raw), F.lit(found)).alias("p")).first().p
    assert got == want
