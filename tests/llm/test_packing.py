import math
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm.packing import RANKS, TOKENIZER, encoder, packed, pieces

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = encoder(public_tokenizers.path(RANKS), public_tokenizers.path(TOKENIZER))


def best_fit(counts, capacity):
    gaps = []
    for size in sorted((s for s in counts for _ in range(counts[s])), reverse=True):
        fit = [g for g in gaps if g >= size]
        gap = min(fit) if fit else capacity
        if fit:
            gaps.remove(gap)
        gaps.append(gap - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_supersteps_against_best_fit(spark, seed):
    rng = random.Random(seed)
    capacity = [10, 50, 2048, 2048][seed]
    sizes = [rng.choice([1, 1, 2, capacity // 5, capacity]) if seed == 0 else min(capacity, int(rng.lognormvariate(math.log(capacity / 4), 1)) + 1) for _ in range(700)]
    got = packed(spark.createDataFrame([(n, s) for n, s in enumerate(sizes)], "n int, length int"), capacity, rows_per_group=50).collect()
    assert sorted((r.n, r.length) for r in got) == list(enumerate(sizes))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    counts = {s: sizes.count(s) for s in sizes}
    assert -(-sum(sizes) // capacity) <= len(bins) <= best_fit(counts, capacity) * 1.01 + 1


def test_one_size_and_refused_lengths(spark):
    ones = packed(spark.range(5000).select(F.lit(1).alias("length"), F.lit("x").alias("offset"), F.lit(0).alias("_row")))
    assert ones.select("sequence_id").distinct().count() == 3 and ones.columns == ["length", "_row", "sequence_id", "offset"]
    for bad in (0, 2049, None):
        with pytest.raises(ValueError):
            packed(spark.createDataFrame([(5,), (bad,)], "length int"))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + "\t" * 600_000 + "b"])
def test_long_runs_of_white_space(text):
    assert ENCODER(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\rabetonE.<>'s|0123😀é中́ "), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_equal_the_library(text):
    assert ENCODER(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "x" * 4000, " " * 3000 + "end", "it's\n\n\n  we'll\t\t"])
def test_ids_equal_the_library_on(text):
    assert ENCODER(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choice(["a", "the", "ranked", "0x"]) for _ in range(rng.choice([3, 30, 900, 5000]))) for _ in range(80))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packed(pieces(docs), rows_per_group=10).collect()
    want = []
    for i, t, _ in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, n, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for n, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    sizes = [w[3] for w in want]
    assert len(bins) <= best_fit({s: sizes.count(s) for s in sizes}, 2048)
    assert packed(pieces(docs.limit(0))).count() == 0
