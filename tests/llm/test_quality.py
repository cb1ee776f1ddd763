import math
import random

import numpy as np
from pyspark.sql import functions as F

from assayer.llm.quality import features, fit, op1_quality, quality

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = op1_quality(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rates = {r.quality: r.p for r in got.where("held_out").join(labels, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.15


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "good words here", 9), (3, "again", 9), (None, "x !!", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (2, 0), (7, 1), (1, None)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality(docs.limit(0), labels).count() == 0


def test_fit_has_no_slope_left():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.6, 1, (80, 4)), rng.normal(0, 1, (50, 4))
    ranking = fit(good, bad, pairs=3000, rounds=60)
    z = np.clip((np.concatenate([good, bad]) - ranking.mean) / ranking.scale, -6, 6)
    draw = np.random.default_rng(5)
    pairs = list(zip(draw.integers(0, 80, 3000), draw.integers(0, 50, 3000)))

    def loss(w):
        total = sum(math.log1p(math.exp(-float((z[a] - z[80 + b]) @ w))) for a, b in pairs)
        return total / len(pairs) + 1e-3 * float(w @ w) / 2

    best = loss(ranking.weights)
    assert all(loss(ranking.weights + step * np.eye(4)[k]) >= best - 1e-12 for k in range(4) for step in (1e-2, -1e-2))
    scores = sorted(ranking.strength(np.concatenate([good, bad])))
    assert sum(x < ranking.cut for x in scores) in (49, 50)


def test_scores_equal_the_plain_ones(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "sea", "Río", "x9", "!!", "|", "HALT"])
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) + "\n" * (n % 3) for n in range(60)] + ["", None, "a" * 300_000, "same text", "same text"]
    rows = [(n, t, "x", 1) for n, t in enumerate(texts)] + [(None, "no id", "x", 1), (5, texts[5], "x", 1)]
    marks = [(n, n % 2) for n in range(60)] + [(4, 1), (7, None), (None, 1), (999, 0), (61, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score string, x int"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality(docs, labels).collect()
    best = {}
    for n, q in marks:
        if n is not None and q is not None and n < len(texts):
            best[n] = max(q, best.get(n, 0))
    learned = sorted((features(texts[n] or ""), q, str(n)) for n, q in best.items())
    ranking = fit(*(np.array([x for x, q, _ in learned if q == k]) for k in (1, 0)))
    want = [1 / (1 + math.exp(-(float(ranking.strength(np.array(features(t or "")))) - ranking.cut + math.log(0.3 / 0.7)))) for _, t, _, _ in rows]
    by_id = lambda pairs: sorted((str(d), round(x, 9)) for d, x in pairs)
    assert by_id((r.doc_id, r.score) for r in got) == by_id((row[0], x) for row, x in zip(rows, want))
    assert all(r.predicted == (r.score >= 0.3) for r in got) and len({r.score for r in got if r.doc_id in (63, 64)}) == 1
