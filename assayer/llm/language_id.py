"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

UNKNOWN = "und"
#: Code points of scripts, first and last. What lies in none is script 0.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7A3), ("Han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
BUCKETS = 1 << 15
#: Characters scored at a time, which bounds the memory whatever the length of a text.
BLOCK = 1 << 20
#: The score of a word in a language that isn't written in its script: far below what any change of language costs.
FOREIGN = -1e6


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter in lower case, or 0 where it is none; and its script."""
    small = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            small[code] = ord(low) if len(low) == 1 else code
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return small, script


def words_of(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of the trigram around each letter, first letter of each word among them, its place in the text, its script), block by block."""
    small, script = letters()
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        while end < len(text) and end - start < 2 * BLOCK and text[end].isalpha():
            end += 1
        codes = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.concatenate([[0], small[codes], [0]]).astype(np.uint64)
        at = np.flatnonzero(low[1:-1])
        mixed = (low[at] * np.uint64(0x9E3779B1) + low[at + 1] * np.uint64(0x85EBCA77) + low[at + 2] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
        bucket = ((mixed * np.uint64(0x27D4EB2F) & np.uint64(0xFFFFFFFF)) >> np.uint64(17)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        yield bucket, first, at[first] + start, script[codes[at[first]]]
        start = end


@dataclass(frozen=True)
class Model:
    """languages, log probabilities (bucket, language) and whether a language is written in a script (script, language)."""

    languages: list[str]
    grams: np.ndarray
    written: np.ndarray

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each word in each language, where it starts, how many letters it has)."""
        parts = [(np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for bucket, first, place, script in words_of(text):
            if not len(first):
                continue
            score = np.add.reduceat(self.grams[bucket], first, axis=0)
            fits = self.written[script]
            score[fits.any(axis=1)[:, None] & ~fits] = FOREIGN
            parts.append((score, place, np.diff(first, append=len(bucket))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, where each change of language costs penalty; texts lie one behind the other and go forward together."""
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, sorted_lengths = begins[order], lengths[order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    came = np.empty(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    best = np.zeros((len(lengths), scores.shape[1]), np.float64)
    for t in range(longest):
        k = active[t]
        rows = begins[:k] + t
        now = best[:k]
        top = now.argmax(axis=1)
        change = now[np.arange(k), top][:, None] - penalty
        came[rows] = np.where(now >= change, own, top[:, None].astype(np.int16))
        now = np.maximum(now, change) + scores[rows]
        best[:k] = now - now.max(axis=1, keepdims=True)
    label = np.zeros(len(scores), np.int16)
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = begins[:k] + t
        label[rows] = state[:k]
        state[:k] = came[rows, state[:k]]
    return label


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 2000) -> Model:
    """Learns from at most about rows_per_language whole texts of each language, taken by a hash of the text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = {k: min(1.0, rows_per_language / n) for k, n in counts.items()}
    bar = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))))
    sample = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < bar[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = grams.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                for bucket, _, _, script in words_of(text):
                    own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for lang, own in grams.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "at": at, "n": own[at]})

    seen = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    for r in sample.mapInPandas(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        seen[r["at"], languages.index(r.lang)] = r.n
    grams = seen[:BUCKETS] + 0.5
    written = seen[BUCKETS:] >= np.maximum(1, 0.01 * seen[BUCKETS:].sum(axis=0))
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), written)


def label(model: Model, texts: list[str], penalty: float) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, its share of the letters, spans) of each text."""
    found = [model.scores(t) for t in texts]
    lengths = np.array([len(f[1]) for f in found], np.int64)
    if not lengths.sum() or not model.languages:
        yield from ((UNKNOWN, 0.0, []) for _ in texts)
        return
    labels = viterbi(np.concatenate([f[0] for f in found]), lengths, penalty)
    at = 0
    for text, (_, place, size), n in zip(texts, found, lengths, strict=True):
        own = labels[at : at + n]
        at += n
        if not n:
            yield UNKNOWN, 0.0, []
            continue
        weight = np.bincount(own, weights=size, minlength=len(model.languages))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        ends = [*place[first[1:]].tolist(), len(text)]
        spans = [{"start": s, "end": e, "lang": model.languages[x]} for s, e, x in zip(place[first].tolist(), ends, own[first], strict=True)]
        yield model.languages[int(weight.argmax())], float(weight.max() / weight.sum()), spans


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 20.0) -> DataFrame:
    """One row per document: id_col, lang_pred, score (its share of the letters), spans (start and end in characters, lang).

    Words are runs of letters. A word's score in a language is the sum of log probabilities of the trigrams around its
    letters; languages that aren't written in its script fall out. Viterbi with a penalty for each change of language
    labels the words, and the language with most letters is the document's. Texts are read whole.

    Null texts and those without letters give und, score 0 and no spans, as all texts do if nothing was learned. Ties go
    to the language first by name. Repeated rows each have a row, an empty table none. Other columns are ignored.
    """

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def spoken(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, block, size = [], [], 0
            for text in texts:
                block.append(text)
                size += len(text)
                if size >= 2 * BLOCK:
                    out += label(model, block, penalty)
                    block, size = [], 0
            out += label(model, block, penalty)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "spans"])

    return docs.select(F.col(id_col), spoken(text_of(text_col)).alias("found")).select(id_col, "found.*")


def held_out(parts: int, rest: int, id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    return languages(docs, fit(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
