import datetime as dt

from assayer.llm import url_filter
from assayer.llm.queries import ORACLES, QUERIES
from assayer.llm.url_filter import judged

from ..oracle import duck, rows

DATA = "/root/testdata/sf0.01"


def day(text):
    return dt.datetime.fromisoformat(text)


def test_query_equals_its_sql(spark):
    got = QUERIES["op6_url_filter"](spark, DATA).toPandas()
    assert rows(got) == rows(duck(ORACLES["op6_url_filter"], DATA)) and set(got.verdict) >= {"block", "none"}


def test_intervals_and_odd_rows(spark):
    listed = [("a.org", "block", "2024-01-01"), ("a.org", "drop", "2024-02-01"), ("x.a.org", "allow", "2024-01-10"), ("a.org/p", "block", "2024-01-05"), (None, "block", "2024-01-01")]
    entries = spark.createDataFrame([(e, a, day(s)) for e, a, s in listed], "entry string, action string, since timestamp")
    cases = [
        ("http://A.org/", "2024-01-01", "block"), ("http://a.org/", "2023-12-31", "none"), ("http://a.org/", "2024-02-01", "none"), ("https://u@y.a.org:8/q", "2024-01-31", "block"),
        ("http://x.a.org/p?z", "2024-01-20", "block"), ("http://x.a.org/", "2024-03-01", "allow"), ("http://ba.org/", "2024-01-15", "none"),
        ("", "2024-01-15", "none"), (None, "2024-01-15", "none"), ("http://a.org/", None, "none"), ("no url", "2024-01-15", "none"),
    ]
    captures = spark.createDataFrame([(n, u, t and day(t), "clash") for n, (u, t, _) in enumerate(cases)] + [(0, "http://A.org/", day("2024-01-01"), "clash")], "n int, url string, fetched_at timestamp, verdict string")
    got = judged(captures, entries).collect()
    assert len(got) == len(captures.collect())
    assert {r.n: r.verdict for r in got} == {n: v for n, (_, _, v) in enumerate(cases)}
    # of x.a.org and a.org/p, equally long, the one first by name decides
    assert next(r for r in got if r.n == 4).listed_entry == "a.org/p"
    assert judged(captures.limit(0), entries).count() == 0 and judged(captures, entries.limit(0)).where("verdict <> 'none'").count() == 0


def test_entries_that_differ_in_case_are_one(spark):
    entries = spark.createDataFrame([("A.org", "block", day("2024-01-01")), ("a.org", "drop", day("2024-02-01"))], "entry string, action string, since timestamp")
    captures = spark.createDataFrame([("http://a.org/", day("2024-01-15")), ("http://a.org/", day("2024-03-01"))], "url string, fetched_at timestamp")
    assert sorted((str(r.fetched_at)[:7], r.verdict) for r in judged(captures, entries).collect()) == [("2024-01", "block"), ("2024-03", "none")]


def test_a_large_list_gives_the_same(spark, monkeypatch):
    entries = spark.createDataFrame([("a.org", "block", day("2024-01-01")), ("b.a.org", "allow", day("2024-01-01"))], "entry string, action string, since timestamp")
    captures = spark.createDataFrame([(f"http://{h}/", day("2024-01-15")) for h in ("a.org", "b.a.org", "c.org", "x.b.a.org", "a.org")], "url string, fetched_at timestamp")
    few = sorted(map(str, judged(captures, entries).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 1)
    assert sorted(map(str, judged(captures, entries).collect())) == few


def test_columns_with_clashing_names_stay(spark):
    entries = spark.createDataFrame([("a.org", "block", day("2024-01-01"))], "entry string, action string, since timestamp")
    captures = spark.createDataFrame([("http://a.org/", day("2024-01-15"), 1, "t", "e", 5, "dot")], "url string, fetched_at timestamp, _url int, _time string, entry string, _row int, `a.b` string")
    got = judged(captures, entries).first()
    assert (got.verdict, got.url, got["_url"], got["_time"], got.entry, got["_row"], got["a.b"], got.listed_entry) == ("block", "http://a.org/", 1, "t", "e", 5, "dot", "a.org")
