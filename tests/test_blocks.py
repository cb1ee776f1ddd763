"""What is written of a group stays small however long the table is, and says the same."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import records, scanners
from assayer.plans import ordering

from .oracle import duck, rows

DATA = "/root/testdata/sf0.001"


def test_a_block_holds_no_more_than_its_size(spark):
    df = ordering.in_blocks(spark.range(0, 1000, 1, 3), size=16)
    assert df.groupBy("_block").count().agg(F.max("count")).first()[0] == 16
    assert df.count() == 1000


def test_a_report_is_written_as_several_small_documents(spark, monkeypatch):
    monkeypatch.setattr(ordering.in_blocks, "__defaults__", ("_block", 100))
    hits = spark.range(1000).selectExpr("0 AS report", "id")
    docs = scanners.documents(hits.coalesce(1), "id", "{}").collect()
    assert len(docs) == 10 and all(len(d.text) < 600 for d in docs)


@pytest.mark.parametrize("name, module", [("ledger_files", records), ("table_rows", records), ("parse_govulncheck", scanners), ("parse_sarif", scanners), ("advisory_rollup", scanners), ("secret_rows", scanners)])
def test_many_blocks_say_what_one_does(spark, monkeypatch, name, module):
    monkeypatch.setattr(ordering.in_blocks, "__defaults__", ("_block", 500))
    assert rows(module.QUERIES[name](spark, DATA).toPandas()) == rows(duck(module.ORACLES[name], DATA))
