import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from assayer.llm.language_id import BUCKETS, FOREIGN, SCRIPT_NAMES, SCRIPTS, Model, fit, label, languages, op8_language_id, viterbi

DATA = "/root/testdata/sf0.01"


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3))
    got = viterbi(scores, lengths, 0.7)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(own[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_mixed_text_scripts_and_odd_rows(spark):
    rng = random.Random(1)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    one, two, three = ["the", "with", "thing"], ["être", "leaux", "mentre"], ["привет", "слово"]
    rows = [(i, text(w), lang, 0) for lang, w in (("a", one), ("b", two), ("c", three)) for i in range(20)] + [(1, None, "a", 0), (2, "x", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = fit(docs)
    assert model.languages == ["a", "b", "c"]
    mixed = text(one) + ". " + text(two) + ". " + text(three)
    asked = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "12 !"), (5, "слово"), (5, "слово")], "doc_id long, text string")
    got = sorted(languages(asked, model).collect(), key=lambda r: r.doc_id)
    assert [s.lang for s in got[0].spans] == ["a", "b", "c"] and got[0].spans[-1].end == len(mixed)
    assert [r.lang_pred for r in got[1:]] == ["und", "und", "und", "c", "c"] and [r.score for r in got[1:]] == [0, 0, 0, 1, 1]
    assert languages(asked.limit(0), model).count() == 0
    assert {r.lang_pred for r in languages(asked, fit(docs.limit(0))).collect()} == {"und"}


def test_word_scores_and_spans_against_plain_ones():
    rng = np.random.default_rng(2)
    written = np.zeros((len(SCRIPT_NAMES), 3), bool)
    written[SCRIPT_NAMES.index("Latin"), :2] = True
    written[SCRIPT_NAMES.index("Cyrillic"), 2] = True
    model = Model(["a", "b", "c"], rng.normal(-3, 1, (BUCKETS, 3)).astype(np.float32), written)
    text = "One, two\n\u0438 three \u043f\u0440\u0438\u0432\u0435\u0442 x ab12cd \u65e5\u672c"
    scores, places, sizes = model.scores(text)
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\W\d_]+", text)]
    assert list(zip(places, sizes)) == [(at, len(w)) for at, w in words]
    for (_, word), got in zip(words, scores):
        grams = [[*(c for c in (ord(x) for x in f"\0{word.lower()}\0"))][i : i + 3] for i in range(len(word))]
        want = sum(model.grams[plain_bucket(g)] for g in grams)
        script = next((s for s, first, last in SCRIPTS if first <= ord(word[0]) <= last), "other")
        fits = written[SCRIPT_NAMES.index(script)]
        assert all(abs(g - (FOREIGN if fits.any() and not f else w)) < 1e-3 for g, w, f in zip(got, want, fits))
    (_, share, spans), = label(model, [text], 5.0)
    assert "".join(text[s["start"] : s["end"]] for s in spans) == text[spans[0]["start"] :] and all(a["end"] == b["start"] for a, b in zip(spans, spans[1:]))
    # one letter in another script is never labelled with a language that isn't written in it
    assert next(s["lang"] for s in spans if s["start"] <= text.index("\u0438") < s["end"]) == "c"
    assert 0 < share <= 1


def plain_bucket(gram):
    """The bucket of three code points, by plain whole numbers."""
    a, b, c = gram
    mixed = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
    return mixed * 0x27D4EB2F % 2**32 >> 17


def test_long_text_in_blocks():
    model = Model(["a", "b"], np.zeros((BUCKETS, 2), np.float32), np.ones((len(SCRIPT_NAMES), 2), bool))
    _, places, sizes = model.scores("ab cde " * 400_000)
    assert len(places) == 800_000 and sizes.sum() == 2_000_000 and places[-1] == 7 * 400_000 - 4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = op8_language_id(spark, DATA).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
