import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer.operators import exports
from assayer.sources import reports
from assayer.sources.documents import Refused, write_documents
from assayer.sources.tree import TreeReader, inventory, tree

ITEM = "run string, id string, category string, severity string, title string, impact string, fix string, proof string, status string, verified boolean, file string, start_line int, end_line int"
RUN = "run string, commit string, date string"


@pytest.fixture
def root(tmp_path):
    def put(path, text=""):
        at = tmp_path / "src" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
        return at

    for path in ("a.ts", "lib/b.py", "lib/deep/er/c.go", "node_modules/x/d.ts", "lib/vendor/e.php", "README.md", "templates/m.html", "other/m.html", "config/routes/x.yaml", "x.routing.yml", ".github/workflows/ci.yml", "go.mod", "lib/deep/go.mod", "Dockerfile", "infra/main.tf", "tests/t.py"):
        put(path, f"text of {path}\r\n")
    put("big.ts", "x" * 1_000_000)
    put("go.sum", "y" * 1_200_000)
    os.utime(put("old.ts", "old"), (1000, 1000))
    (tmp_path / "src" / "link.ts").symlink_to(tmp_path / "src" / "a.ts")
    (tmp_path / "src" / "linked").symlink_to(tmp_path / "src" / "lib")
    (tmp_path / "src" / "odd.ts").write_bytes(b"\xff\xfe ok")
    return str(tmp_path / "src")


def test_tree_reads_source_and_lists_lock_files(spark, root):
    rows = {r.path: r for r in tree(spark, root).collect()}
    assert set(rows) == {"a.ts", "lib/b.py", "lib/deep/er/c.go", "templates/m.html", "config/routes/x.yaml", "x.routing.yml", "go.sum", "old.ts", "odd.ts", "tests/t.py"}
    assert rows["lib/b.py"].text == "text of lib/b.py\r\n" and rows["lib/b.py"].size == 18
    assert rows["go.sum"].lockfile and rows["go.sum"].text is None and rows["go.sum"].size == 1_200_000
    assert rows["odd.ts"].text == "�� ok"
    for folders in (1, 2, 1000):
        assert {r.path for r in tree(spark, root, folders=folders).collect()} == set(rows)
    assert {r.path for r in tree(spark, root, modifiedAfter=1000).collect()} == set(rows) - {"old.ts"}
    assert {r.path for r in tree(spark, root, under="lib/deep").collect()} == {"lib/deep/er/c.go"}
    assert tree(spark, root, under="nowhere").count() == 0


def test_pruned_folders_are_not_opened(root, monkeypatch):
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, root)) or scandir(path))
    for options in ({}, {"folders": "1"}, {"folders": "500"}):
        reader = TreeReader({"path": f"file://{root}", **options})
        found = [row[0] for p in reader.partitions() for row in reader.read(p)]
        assert len(found) == len(set(found)) == 10
    assert not any(part in path.split("/") for path in opened for part in ("node_modules", "vendor", "linked"))
    opened.clear()
    reader = TreeReader({"path": root, "under": "lib/deep"})
    assert [row[0] for p in reader.partitions() for row in reader.read(p)] == ["lib/deep/er/c.go"]
    assert set(opened) == {".", "lib", "lib/deep", "lib/deep/er"}


def test_many_folders_are_few_tasks(tmp_path):
    for n in range(300):
        (tmp_path / f"p{n}" / "src").mkdir(parents=True)
        (tmp_path / f"p{n}" / "src" / "a.ts").write_text("x")
    parts = TreeReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 64
    assert sorted(row[0] for p in parts for row in TreeReader({"path": str(tmp_path)}).read(p)) == sorted(f"p{n}/src/a.ts" for n in range(300))


def test_inventory_reads_the_tree_once(spark, root):
    plan = inventory(tree(spark, root, files="all"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1


def test_inventory(spark, root):
    got = {r.what: (r.n, r.paths) for r in inventory(tree(spark, root, files="all")).collect()}
    assert got["language python"][0] == 2 and got["runtime python"][0] == 1 and got["language ts"][0] == 4
    assert got["go.mod"] == (2, ["go.mod", "lib/deep/go.mod"]) and got["workflow"] == (1, [".github/workflows/ci.yml"])
    assert got["dockerfile"] == (1, ["Dockerfile"]) and got["iac"] == (1, ["infra/main.tf"])


def names(folder):
    """What readers see; a task that is stopped late may leave something in a hidden folder."""
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files if "/.writing-" not in d)


def test_documents_appear_all_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "out")
    docs = spark.createDataFrame([(f"d/{i}.txt", f"text {i}\r\n") for i in range(20)] + [("null.txt", None)], "path string, text string").repartition(5)
    write_documents(docs, folder)
    assert names(folder) == sorted([*(f"d/{i}.txt" for i in range(20)), "null.txt"])
    with open(f"{folder}/d/3.txt", newline="") as file:
        assert file.read() == "text 3\r\n"
    new = docs.withColumn("text", F.lit("new"))
    for bad in ("../x", "/x", "a//b", "d/3.txt"):  # the last one twice
        with pytest.raises(PySparkException):
            write_documents(new.unionByName(spark.createDataFrame([(bad, "x")], "path string, text string")), folder)
        assert len(names(folder)) == 21 and open(f"{folder}/d/4.txt").read() == "text 4\n"
    with pytest.raises(PySparkException):
        write_documents(new.withColumn("text", F.when(F.col("path") == "d/7.txt", F.raise_error(F.lit("no"))).otherwise(F.col("text"))), folder)
    assert len(names(folder)) == 21 and open(f"{folder}/d/4.txt").read() == "text 4\n"
    errors = spark.createDataFrame([("f1", "no status")], "id string, error string")
    with pytest.raises(Refused, match="f1, no status"):
        write_documents(new, folder, errors)
    assert open(f"{folder}/d/4.txt").read() == "text 4\n"
    write_documents(new, folder, errors.limit(0))
    assert open(f"{folder}/d/4.txt").read() == "new"
    write_documents(new.limit(0), str(tmp_path / "nothing"))
    assert names(str(tmp_path / "nothing")) == []


def items(spark, rows):
    full = [{**{k.split()[0]: None for k in ITEM.split(", ")}, **r} for r in rows]
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in ITEM.split(", ")) for r in full], ITEM)


def test_sarif_documents(spark):
    rows = [{"run": "r1", "id": "F1", "category": "auth", "severity": "HIGH", "title": 'A "b"', "impact": "bad", "fix": "do", "proof": "test", "status": "open", "file": "a.ts", "start_line": 3, "end_line": 5},
            {"run": "r1", "id": "F2", "severity": "ODD", "title": "t", "status": "open", "file": "b.ts"}, {"run": "r1", "id": "F3", "category": "c", "severity": "LOW", "title": "n", "status": "partial"}]
    runs = spark.createDataFrame([("r1", "abc", "2024"), ("r2", None, None)], RUN)
    docs = {r.path: json.loads(r.text) for r in exports.sarif_documents(items(spark, rows), runs).collect()}
    assert len(docs) == 2 and all(d["version"] == "2.1.0" and d["$schema"].endswith("sarif-2.1.0.json") for d in docs.values())
    empty = docs["r2-0-0.sarif"]["runs"][0]
    assert empty["results"] == [] and empty["tool"]["driver"]["rules"] == [] and empty["tool"]["driver"]["semanticVersion"] == "1.1.0"
    run = next(d for p, d in docs.items() if p.startswith("r1"))["runs"][0]
    assert run["properties"] == {"audited_commit": "abc", "audit_date": "2024"}
    rules, results = run["tool"]["driver"]["rules"], run["results"]
    assert [r["id"] for r in rules] == [r["ruleId"] for r in results] == ["F1", "F2", "F3"] and [r["ruleIndex"] for r in results] == [0, 1, 2]
    assert rules[0]["properties"] == {"tags": ["security", "auth"], "security-severity": "8.0", "precision": "very-high"} and rules[1]["properties"]["tags"] == ["security"]
    assert [r["level"] for r in results] == ["error", "warning", "note"] and results[0]["message"]["text"] == 'A "b". bad'
    assert results[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "endLine": 5}
    assert "region" not in results[1]["locations"][0]["physicalLocation"] and "locations" not in results[2]


def test_documents_are_bounded(spark):
    rows = [{"run": "big", "id": f"F{i:05}", "severity": "LOW", "title": "t", "status": "open", "verified": True, "category": "a b"} for i in range(1000)]
    found = items(spark, rows)
    runs = spark.createDataFrame([("big", "", "")], RUN)
    docs = exports.sarif_documents(found, runs, 50).collect()
    sizes = [len(json.loads(d.text)["runs"][0]["results"]) for d in docs]
    assert sum(sizes) == 1000 and max(sizes) <= 50
    back = reports.sarif(spark.createDataFrame([(d.path, d.text) for d in docs], "report string, text string"))
    assert sorted(r.rule for r in back.collect()) == [r["id"] for r in rows]
    whole = [json.loads(d.text) for d in exports.remediation_documents(found, runs, 50).collect()]
    assert sum(len(d["findings"]) for d in whole) == 1000 and {d["summary"]["verified_total"] for d in whole} == {1000}
    lines = [d.text.split("\r\n") for d in exports.tracker_documents(found, "jira", 50).collect()]
    assert all(x[0] == '"Summary","Description","Issue Type","Priority","Labels","Labels"' and x[-1] == "" and len(x) <= 52 for x in lines)
    assert lines[0][1].endswith('"Low","security","a-b"')
    with pytest.raises(ValueError):
        exports.tracker_documents(found, "other")


def test_documents_of_nothing(spark):
    none = items(spark, [])
    runs = spark.createDataFrame([], RUN)
    assert exports.sarif_documents(none, runs).count() == exports.remediation_documents(none, runs).count() == exports.tracker_documents(none, "linear").count() == 0
