import hashlib
import random
import re

from assayer.llm.queries import ORACLES, QUERIES
from assayer.llm.secret_scan import ADDED, BASE, Rule, findings, scan

from ..oracle import duck, rows

#: The base rules as they are stated.
STATED = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def plain(text):
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, pattern, holds) in enumerate(STATED) for m in pattern.finditer(text or "") if holds(m)]
    return [x[2] for x in sorted(found)]


def random_text(rng):
    parts = ["password", "PassWd", "ſecret", "secret", "API_KEY", "apiKey", "toKen", '"', "'", " ", "  ", ":", "=", "abcdefABCDEF", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKLMN", "é😀", "deadbeef", "+/_.=-", "\n", "xyz", "Z9"]
    return "".join(rng.choices(parts, k=rng.randrange(60)))


def test_spans_against_the_stated_patterns(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "x " * 200_000 + "token=abcdefabcdefab", *(random_text(rng) for _ in range(600))]
    texts += texts[50:80]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(7, texts[7], "b", 2), (None, texts[9], "c", 3)], "doc_id long, text string, blob string, spans int")
    folder = str(tmp_path / "ledger")
    assert scan(docs, BASE, folder, id_col="doc_id") == len({t or "" for t in texts})
    got = findings(docs, BASE, folder, id_col="doc_id").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[9] if r.doc_id is None else texts[r.doc_id]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] == plain(text)
        assert r.blob == hashlib.sha256((text or "").encode()).hexdigest()


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    key, pem = "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----"
    first = spark.createDataFrame([("a", key), ("b", key), ("c", pem), ("d", None)], "path string, text string")
    assert scan(first, BASE, folder) == 3 and scan(first, BASE, folder) == 0
    more = first.unionByName(spark.createDataFrame([("e", "abcdefabcdefabcdef"), ("f", key)], "path string, text string"))
    assert scan(more, BASE, folder) == 1
    found = {r.path: [(s.kind, s.start, s.end) for s in r.spans] for r in findings(more, BASE, folder).collect()}
    assert found == {"a": [("access", 0, 20)], "b": [("access", 0, 20)], "c": [], "d": [], "e": [("hex", 0, 18)], "f": [("access", 0, 20)]}
    assert scan(more, BASE + ADDED, folder) == 4 and scan(more, BASE + ADDED, folder) == 0  # the new rules alone
    assert [s.kind for r in findings(more.where("path = 'c'"), BASE + ADDED, folder).collect() for s in r.spans] == ["pem"]
    later = (BASE[0], Rule("access", "AKIA[A-Z0-9]{30,}", version=2), BASE[2])
    assert scan(more, later, folder) == 4
    assert [s for r in findings(more, later, folder).collect() for s in r.spans if s.kind == "access"] == []
    assert sum(len(r.spans) for r in findings(more, BASE, folder).collect()) == 4


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "path string, text string")
    folder = str(tmp_path / "ledger")
    assert scan(none, BASE, folder) == 0 and findings(none, BASE, folder).count() == 0


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    got = rows(QUERIES["op12_secret_scan"](spark, data).toPandas())
    assert got == rows(duck(ORACLES["op12_secret_scan"], data))
