import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest

from assayer.llm import resampling
from assayer.llm.queries import QUERIES
from assayer.llm.resampling import Tournament, resampled

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most=1):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=10, least=20, buckets=10_000, most=1):
    """(doc_id, n_features, weight, score, rank) by the contract, on lists of (doc_id, text) and of texts."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = Counter(bucket(f) for _, t in docs for f in features(t, most)[1])
    aim = Counter(bucket(f) for t in target for f in features(t, most)[1])
    s, t = sum(source.values()), sum(aim.values())
    out = []
    for doc_id, text in docs:
        words, of = features(text, most)
        weight = sum(math.floor(1000 * math.log((aim[bucket(f)] + 1) * (s + buckets) / ((source[bucket(f)] + 1) * (t + buckets)))) for f in of)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n for n, r in enumerate(order[: len(order) * percent // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def test_tournament_merges_as_a_heap_does():
    rng = random.Random(3)
    for count in (1, 2, 3, 5, 8, 33):
        runs = [sorted((rng.randrange(50), i, n) for n in range(rng.randrange(40))) for i in range(count)]
        assert list(Tournament(runs)) == list(heapq.merge(*runs))
    assert list(Tournament([])) == [] and list(Tournament([[], []])) == []


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert got(QUERIES["op11_resampling"](spark, data)) == plain(docs, target)


def test_many_ranges_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 40)
    rng = random.Random(4)
    words = ["Alpha", "beta", "É", "é", "10", "_", "x-y", "ſ", "K", "gamma"]
    rows = [(i, None if i % 50 == 7 else " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(900)]
    rows += [(rows[5][0], "same " * 30)] * 3 + [(None, "none " * 40), (2_000, ""), (2_001, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, rank int, row string").repartition(7)
    target = spark.createDataFrame([("alpha beta",), (None,), ("10 10 é",)], "text string")
    aim = ["alpha beta", None, "10 10 é"]
    assert got(resampled(docs, target, percent=35)) == plain(rows, aim, percent=35)
    assert got(resampled(docs, target, most=2, buckets=97)) == plain(rows, aim, most=2, buckets=97)
    none = got(resampled(docs, target.limit(0), percent=0))
    assert len(none) == len(rows) and all(r[4] is None for r in none)
    assert resampled(docs.limit(0), target).count() == 0
    ids = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert {r.rank for r in resampled(ids, target, percent=35).collect()} == {r[4] for r in plain(rows, aim, percent=35)}
