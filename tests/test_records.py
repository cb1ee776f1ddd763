import pytest

from assayer.sources.records import findings, head, ledgers, markdown_rows, usage
from assayer.sources.reports import bandit, gosec, hadolint, sarif, semgrep, trivy

HEAD = """---
id: auth-101   # a comment
severity: HIGH
  x: 1
2nd-key: "a \\"quoted\\" # text"  # gone
single: 'it''s'
flow: [a, "b c", 'd']
json: ["x, y", 2]
remediation:
  status: fixed
  fix_evidence:
    - src/a.ts:3
    - "b # c"
tags:
  - one
  - two # two
empty:
block: |
  lost
no field here
---
## Title
Body
"""


def test_a_head_in_full():
    fields, remediation, body, errors = head(HEAD.replace("\n", "\r\n"))
    assert fields == {"id": "auth-101", "severity": "HIGH", "2nd-key": 'a "quoted" # text', "single": "it's", "flow": '["a", "b c", "d"]', "json": '["x, y", 2]', "tags": '["one", "two"]', "block": "|"}
    assert remediation == {"status": "fixed", "fix_evidence": '["src/a.ts:3", "b # c"]'}
    assert body == "## Title\nBody\n"
    assert errors == ["unexpected indentation: x: 1", "text over several lines: block", "not a field: lost", "not a field: no field here"]


@pytest.mark.parametrize("text", [None, "", "no head", "---\nid: 1\n", "text\n---\nid: 1\n---\n"])
def test_texts_without_a_head(text):
    assert head(text) == ({}, None, text or "", ["no head"])


def test_findings_of_odd_texts(spark):
    rows = [("a", HEAD), ("b", None), ("c", "---\n---\n"), ("d", "---\nid: " + "x" * 200_000 + "\n---\n"), ("a", HEAD)]
    got = findings(spark.createDataFrame([(*r, "clash") for r in rows], "name string, text string, body string").drop("body")).collect()
    assert len(got) == 5 and [len(r.errors) for r in sorted(got, key=lambda r: r.name)] == [4, 4, 1, 0, 0]
    assert findings(spark.createDataFrame([], "name string, text string")).count() == 0


def test_readers_of_broken_texts(spark):
    texts = [None, "", "{", "[]", "{}", "null", "7", '{"results": 3}', '{"runs": [null, {"results": [null]}]}', '[{"file": null}]']
    reports = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "report string, text string")
    for reader in (semgrep, bandit, gosec, sarif, hadolint, trivy):
        for row in reader(reports).collect():
            assert row.line == 0 and row.severity in ("info", "medium")
        assert reader(reports.limit(0)).count() == 0
    named = reports.withColumnRenamed("report", "name")
    assert {r.error for r in ledgers(named).collect()} <= {None, "not valid JSON"} and markdown_rows(named).count() == 0
    assert usage(reports.selectExpr("1 AS ord", "text")).count() == 0
