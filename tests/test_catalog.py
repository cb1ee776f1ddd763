import pytest

from assayer.catalog import ORACLES, QUERIES

from .oracle import duck, rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck(ORACLES[name], DATA))
    else:
        assert list(got.columns)


@pytest.mark.parametrize("name", ["page_scores", "hotspots_top20", "affected_files", "secondary_match"])
def test_query_equals_its_sql_on_more_rows(spark, name):
    data = "/root/testdata/sf0.01"
    got = rows(QUERIES[name](spark, data).toPandas())
    assert got and got == rows(duck(ORACLES[name], data))


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
