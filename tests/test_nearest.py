"""Operators on places against their SQL, and what their plans hold."""

import pytest

from assayer.operators import coverage, findings, graphs

from .oracle import duck, rows

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, module", [("key_overlaps", graphs), ("missing_classes", coverage), ("nearest_interval", findings), ("recall_score", findings)])
def test_as_in_sql(spark, name, module):
    assert rows(module.QUERIES[name](spark, DATA).toPandas()) == rows(duck(module.ORACLES[name], DATA))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_that_overlap_come_out_once_without_being_kept(spark):
    assert "Aggregate" not in plan(graphs.key_overlaps(spark, DATA))


def test_the_ledger_meets_the_classes_as_distinct_ones(spark):
    assert "Aggregate" in plan(coverage.missing_classes(spark, DATA))


def test_places_of_many_findings_and_entries_meet_once(spark):
    found = spark.range(3000).selectExpr("id", "'raw' AS status", "'f' AS file", "10 AS start_line", "CAST(if(id % 2 = 0, 12, null) AS INT) AS end_line")
    key = spark.range(3000).selectExpr("id AS key_id", "'seeded' AS kind", "'f' AS file", "13 AS lo", "CAST(13 + id % 2 AS INT) AS hi")
    assert sorted(tuple(r) for r in findings.nearest_places(found, key).collect() if r.end_line) == [("f", 10, 12, 13, 13, 1), ("f", 10, 12, 13, 14, 1)]
    few = findings.nearest(found.where("id < 4"), key.where("id < 3"))
    assert few.where("distance = 1").count() == 6 and few.where("id % 2 = 1").count() == 6
