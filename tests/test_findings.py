import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayer.operators import findings

ROOT = Path(__file__).resolve().parents[1]


def test_prerequisites_lower_a_severity(spark, monkeypatch):
    given = [("CRITICAL", 5, "CRITICAL"), ("HIGH", 1, "HIGH"), ("HIGH", 2, "MEDIUM"), ("HIGH", 4, "LOW"), ("MEDIUM", 3, "LOW"), ("MEDIUM", 4, "LOW"), ("LOW", 9, "LOW"), ("LOW", None, "LOW"), ("HIGH", None, "HIGH"), ("?", 2, "LOW")]
    rows = spark.createDataFrame([(n, s, p) for n, (s, p, _) in enumerate(given)], "id int, severity string, prerequisites int")
    monkeypatch.setattr(findings, "view", lambda *_: rows)
    out = findings.severity_downgrade(spark, "")
    assert {r.id: r.effective for r in out.collect()} == {n: e for n, (_, _, e) in enumerate(given)}


@pytest.mark.parametrize("module", sorted(str(p.relative_to(ROOT)) for p in ROOT.glob("assayer/**/*.py")))
def test_functions_of_spark_are_there(module):
    assert not [name for name in re.findall(r"\bF\.(\w+)", (ROOT / module).read_text()) if not hasattr(F, name)]
