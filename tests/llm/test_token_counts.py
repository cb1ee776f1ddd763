import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm.token_counts import Counter, merges, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER, LIBRARY = Counter(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_merges_takes_the_lowest_rank_and_then_the_leftmost():
    assert merges(list("aaaa"), {"aa": 1}) == 2
    assert merges(list("abc"), {"ab": 2, "bc": 1, "abc": 3}) == 2
    assert merges(list("abc"), {"ab": 2, "bc": 1}) == 1
    assert merges([], {}) == merges(["a"], {"aa": 1}) == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁abetonE.<>s0x/|😀é中́"), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("text", ["<s> </s> <unk> <0x0A>", "  two  spaces ", "a\n\n b \n", "\n", " ", "x" * 5000, "the " * 3000 + " ", "\r\n\tend", "<|endoftext|>"])
def test_counts_equal_the_library_on(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_token_counts(spark):
    rng = random.Random(1)
    texts = [None, "", *(" ".join("".join(rng.choices("etaoin shr\n", k=9)) for _ in range(rng.choice([3, 5000]))) for _ in range(30))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "again", "x")], "doc_id long, text string, n_tokens string")
    got = token_counts(docs).collect()
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in enumerate(texts)] + [(3, 5, len(LIBRARY.encode("again")))]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((*w, w[2] > 4096) for w in want)
    assert any(r.over_limit for r in got) and token_counts(docs.limit(0)).count() == 0
