"""What is worked out for large tables: how often, by what, and that results stay the same."""

import json
import re

import pytest
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from assayer.functions.patterns import java
from assayer.operators import graphs, scanners
from assayer.operators.findings import WINDOW
from assayer.operators.imports import IMPORT
from assayer.sources import reports
from assayer.sources.documents import AT_A_TIME, write_documents

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranked_dependencies_are_parsed_once(spark, monkeypatch):
    """Ranges are found by a sample; what is sampled must not be the reports themselves."""
    given = []
    monkeypatch.setattr(scanners, "ranked", lambda rows, order, name: given.append(rows) or rows.withColumn(name, F.lit(1)))
    scanners.dependencies_by_cvss(spark, SF)
    assert "LogicalRDD" in plan(given[0]) and "from_json" not in plan(given[0])


def test_elements_are_made_before_they_are_collected(spark):
    hits = spark.createDataFrame([(1, 5), (1, None)], "report int, line int")
    out = scanners.documents(hits.coalesce(1), "named_struct('a', line, 'b', 'x')", '{{"results":{}}}')
    aggregate = next(line for line in plan(out).splitlines() if "Aggregate" in line)
    assert "collect_list(" in aggregate and "named_struct" not in aggregate
    assert json.loads(out.first().text) == {"results": [{"a": 5, "b": "x"}, {"b": "x"}]}


def package(name: str, groups, vulnerabilities) -> dict:
    return {"package": {"name": name, "version": "1", "ecosystem": "npm"}, "groups": groups, "vulnerabilities": vulnerabilities}


def affected(*fixed) -> dict:
    return {"affected": [{"ranges": [{"events": [{"fixed": f} for f in fixed]}]}]}


def test_advisories_have_no_nested_lambdas_and_the_same_fields(spark):
    packages = [
        package("scores", [{"ids": ["GHSA-1", "CVE-1"], "max_severity": "7.5"}, {"ids": ["GHSA-2"], "max_severity": ""}, {"ids": [], "max_severity": "high"}, {"ids": None, "max_severity": " 9 "}], [affected("1", None, "2"), affected("2", "3", "4", "5")]),
        package("nothing", [], []),
        package("unknown", None, None),
        package("gaps", [{"ids": ["x"], "max_severity": None}], [affected("1"), {"affected": None}]),
        package("ranges", [None], [{"affected": [{"ranges": None}]}]),
    ]
    text = json.dumps({"results": [{"source": {"path": "p.lock"}, "packages": packages}]})
    out = reports.advisories(spark.createDataFrame([("r", text), ("s", None), ("t", "{")], "report string, text string"))
    rows = {r.name: (r.cvss, r.ids, r.fixed) for r in out.collect()}
    assert rows == {
        "scores": (9.0, ["CVE-1", "GHSA-2", None, None], ["1", "2", "3", "4"]),
        "nothing": (None, [], []), "unknown": (None, None, None), "gaps": (None, ["x"], None), "ranges": (None, [None], None),
    }
    fixed = next(f for f in out._jdf.queryExecution().optimizedPlan().toString().split(" AS ") if "affected" in f and "slice" in f)
    assert "lambdafunction" not in fixed


def test_prefixes_double_and_collect_nothing(spark):
    """Chains of any length up to the depth, a prefix that is empty or null, a parent that isn't there."""
    nodes = [(n, n - 1 if n else None, "" if n % 3 == 0 else f"p{n}") for n in range(20)] + [(50, 99, "alone"), (51, 50, None)]
    prefix, parent = {i: p for i, _, p in nodes}, {i: p for i, p, _ in nodes}

    def route(i: int, depth: int) -> str:
        parts = []
        for _ in range(depth + 1):
            if i not in prefix:
                break
            parts.insert(0, prefix[i])
            i = parent[i]
        return "/".join(p for p in parts if p)

    df = spark.createDataFrame(nodes, "id int, parent int, prefix string")
    for depth in (0, 1, 5, 12):
        out = graphs.routes(df, depth)
        assert {r.id: r.route for r in out.collect()} == {i: route(i, depth) for i in prefix}
    assert "collect_list" not in plan(out) and "Union" not in plan(out)


def test_copies_make_no_pairs_of_secondary_places(spark):
    """No id is in a window or a join of places with entries, and the rows are those of all pairs."""
    assert "windowspecdefinition(id" not in plan(graphs.secondary_match(spark, SF))
    places = [(i, n, f"f{i % 3}" if i % 7 else None, None if i == 8 else (i * 13 + n * 40) % 120) for i in range(40) for n in range(3)]
    key = [(k, f"f{k % 3}", k * 7 % 130, k * 7 % 130 + k % 4, "decoy" if k % 3 == 0 else "seeded") for k in range(60)] + [(k + 100, "f1", 20, 21, "seeded") for k in range(5)]
    best = {}
    for i, n, file, line in places:
        gaps = [(0 if line is None else max(0, lo - line, line - hi), k, kind) for k, f, lo, hi, kind in key if f == file]
        near = min((g for g, _, _ in gaps if g <= WINDOW), default=None)
        for g, k, kind in gaps:
            if g == near and kind != "decoy":
                best[i] = min(best.get(i, (g, n, k)), (g, n, k))
    out = graphs.secondary(spark.createDataFrame(places, "id int, n int, file string, line int"), spark.createDataFrame(key, "key_id int, file string, lo int, hi int, kind string"))
    assert {r.id: (r.distance, r.key_id) for r in out.collect()} == {i: (d, k) for i, (d, _, k) in best.items()}


def test_documents_go_to_python_a_few_at_a_time(spark, monkeypatch, tmp_path):
    """And the session's own batches are as before, also after an error."""
    batch, seen, save = "spark.sql.execution.arrow.maxRecordsPerBatch", [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **k: seen.append(int(spark.conf.get(batch))) or save(self, *a, **k))
    before = spark.conf.get(batch)
    docs = spark.range(100).coalesce(1).selectExpr("concat('d', id) AS path", "repeat('x', 1000) AS text")
    write_documents(docs, str(tmp_path / "out"))
    assert seen == [AT_A_TIME] and spark.conf.get(batch) == before
    assert len([p for p in (tmp_path / "out").iterdir() if p.stat().st_size == 1000]) == 100
    with pytest.raises(Exception, match="no place below"):
        write_documents(docs.withColumn("path", F.lit("../x")), str(tmp_path / "out"))
    assert spark.conf.get(batch) == before


def test_edges_before_plain_letters_are_looked_up_at_one_side():
    """They find what an edge finds, and other edges stay as they were."""
    assert java(IMPORT.pattern).count("(?<![A-Za-z0-9_])") == 5 and "(?<=[A-Za-z0-9_])" not in java(IMPORT.pattern)
    assert all("(?<=[A-Za-z0-9_])" in java(p) for p in (r"\ba?b", r"\b[ab]", r"a\b", r"\b(a|b)", r"\ba*")) and java(r"\\bfrom") == r"(?d)\\bfrom"
    for text in ("from", "xfrom", "_from", "9from", ".from", "éfrom", "from from", "\nfrom", "from\x00from"):
        assert [m.span() for m in re.finditer(java(r"\bfrom")[4:], text)] == [m.span() for m in re.finditer(r"(?a:\b)from", text)]
