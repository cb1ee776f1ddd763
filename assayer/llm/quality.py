"""Quality scores by Bradley-Terry ranking: preference pairs, a logistic loss on feature differences, a threshold by quantile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, text_of
from .language_id import held_out
from .words import cleaned, words_of

FEATURES = ["upper", "symbols", "marks", "digits", "high", "distinct", "lines", "repeats", "word", "spread", "odd", "pipes", "length", "line_length", "twice", "crossed"]
#: Besides the form, the share of a text's words in each of so many groups of words, by hash.
WORD_GROUPS = 64
FEATURES += [f"words{n}" for n in range(WORD_GROUPS)]
#: The score at which a document counts as good.
CUT = 0.3


def features(text: str) -> list[float]:
    """Numbers that describe the form and the words of a whole text."""
    group = np.bincount((words_of(cleaned(text)).hashes >> np.uint64(58)).astype(np.int64), minlength=WORD_GROUPS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, int(raw.sum()))
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    symbols = int(raw[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words)) if words else np.zeros(1)
    pairs = set(zip(words, words[2:], strict=False))
    odd = sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words)
    return [
        upper / max(1, upper + lower), symbols / total, int(raw[33] + raw[63]) / total, digits / total, int(raw[128:].sum()) / total,
        len(set(words)) / n, len(set(lines)) / max(1, len(lines)), 1 - len(pairs) / max(1, len(words) - 2), float(sizes.mean()) / 10, float(sizes.std()) / 10,
        odd / n, int(raw[124]) / n, float(np.log1p(len(words))) / 10, float(np.log1p(total / max(1, len(lines)))) / 10,
        float(upper / max(1, upper + lower) > 0.3), (1 - len(set(words)) / n) * float(np.log1p(len(words))) / 10,
        *(group / max(1, int(group.sum()))).tolist(),
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the cut in the scores that stands for CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = 40_000, penalty: float = 1e-3, rounds: int = 25) -> Ranking | None:
    """Bradley-Terry: P(a before b) = sigmoid(w.(a - b)) over pairs of a good and a bad document, by Newton's steps.

    The cut is the quantile of all scores under which the share of bad documents lies. None without one of either.
    """
    if not len(good) or not len(bad):
        return None
    both = np.concatenate([good, bad])
    ranking = Ranking(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6), np.zeros(both.shape[1]), 0.0)
    rng = np.random.default_rng(5)
    z = np.clip((both - ranking.mean) / ranking.scale, -6, 6)
    d = z[rng.integers(0, len(good), pairs)] - z[len(good) + rng.integers(0, len(bad), pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (1 - p) / pairs - penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
    cut = float(np.quantile(z @ w, len(bad) / len(both)))
    return Ranking(ranking.mean, ranking.scale, w, cut)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and x, the features of each whole text."""

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return docs.select(id_col, numbers(text_of(text_col)).alias("x"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.3).

    labels (doc_id, quality) are learned from, at most about rows of them taken by a hash of doc_id. Documents are
    described by their whole text in one pass; the ranking is a dot product over that. A score is the logistic function of the strength,
    moved so that the quantile cut lies at 0.3.

    Null texts count as empty and have a score. Labels without a document or a quality are left out, of several labels of a
    document the best counts, and of several documents of a label the one with the least features; where good or bad
    ones are missing altogether every score is 0.5. Equal texts have equal scores, long ones are read whole. Repeated rows
    each have a row, an empty table none. Other columns are ignored.
    """
    seen = checkpointed(described(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = checkpointed(known)
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    learned = seen.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()  # a bounded sample
    learned.sort(key=lambda r: (r.x, r.quality, str(r.doc_id)))  # so that a second run learns the same
    part = {q: np.array([r.x for r in learned if r.quality == q], float).reshape(-1, len(FEATURES)) for q in (0, 1)}
    ranking = fit(part[1], part[0])
    if ranking is None:
        score = F.lit(0.5)
    else:
        mean, scale, weights = (F.lit(v.tolist()).cast("array<double>") for v in (ranking.mean, ranking.scale, ranking.weights))
        z = F.transform("x", lambda v, i: F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (v - F.get(mean, i)) / F.get(scale, i))) * F.get(weights, i))
        strength = F.aggregate(z, F.lit(-ranking.cut + float(np.log(CUT / (1 - CUT)))), lambda a, v: a + v)
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-strength))
    return seen.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(5, 0)
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~out))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
