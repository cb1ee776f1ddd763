import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayer.llm import alignment as al
from assayer.llm.queries import QUERIES

A, B = al.tokenizers(public_tokenizers.path(al.A_FILE), public_tokenizers.path(al.A_RANKS), public_tokenizers.path(al.B_FILE))
LIBRARY = Tokenizer.from_file(public_tokenizers.path(al.A_FILE))
LIBRARY.encode_special_tokens = True


def tokens(text):
    """(id, start, end) of A and of B over the whole text, or nothing if bytes differ."""
    want = (" " + text).encode()
    sides = LIBRARY.encode(" " + text, add_special_tokens=False).ids, B.library.encode(text)
    out = []
    for ids, of in zip(sides, (A.bytes, B.bytes), strict=True):
        if not text or b"".join(of[i] for i in ids) != want:
            return None
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(of[i])))
            at += len(of[i])
        out.append(side)
    return out


def plain(texts):
    """By text: n_a, n_b, n_groups, n_links, n_best, count_sum and the groups' digest, by comparing all tokens."""
    links, heads = [], []
    for text in texts:
        two = tokens(text or "")
        if two is None:
            links.append([])
            heads.append((0, 0, 0, ""))
            continue
        a, b = two
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        both = sorted({x[2] for x in a} & {y[2] for y in b})
        within = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if s >= lo and e <= hi)
        groups = [f"{within(a, lo, hi)}|{within(b, lo, hi)}" for lo, hi in zip([0, *both], both, strict=False)]
        heads.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for one in links for p in one)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*h[:3], len(one), sum(count[p] == most[p[1]] for p in one), sum(count[p] for p in one), h[3]) for h, one in zip(heads, links, strict=True)]


def numbers(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def of_words(text):
    words = al.words_of(text)
    two = A.encode(words), B.encode(words)
    assert all(len(n) == len(words) and n.sum() == len(ids) for ids, n in two)
    return two[0][0].tolist(), two[1][0].tolist()


ODD = st.text(alphabet=st.one_of(st.sampled_from("  \n\t▁abetonE.<>s0x/|😀é中́'\x1c\x85　"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60)


@settings(max_examples=600, deadline=None)
@given(ODD)
def test_words_give_the_ids_of_the_whole_text(text):
    assert "".join(" " + w for w in al.words_of(text)) == " " + text
    assert of_words(text) == (LIBRARY.encode(" " + text, add_special_tokens=False).ids, B.library.encode(text))


@pytest.mark.parametrize("text", ["<|endoftext|> <s> </s> <unk> <0x0A>", "  two  spaces ", "a\n\n b \n", "\n", " ", "x" * 5000, "the " * 3000, "\r\n\tend", "don't 'S we'll", " " * 3000 + "x"])
def test_words_give_the_ids_of(text):
    assert of_words(text) == (LIBRARY.encode(" " + text, add_special_tokens=False).ids, B.library.encode(text))


def test_alignment_against_all_pairs_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(al, "CHUNK", 500)
    rng = random.Random(2)
    parts = ["the", "hello", "naïve", "中文", "😀", "\n", " ", "▁", "1234", "don't", "<|endoftext|>", "token", "ization", "é", "\x00", "é"]
    texts = [None, "", " ", "▁", "x" * 3000, *(" ".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(150))]
    texts += texts[20:60]
    docs = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(texts)] + [(9, texts[9], "c", [2]), (None, texts[11], "c", [3])], "doc_id long, text string, row string, a array<int>").repartition(3)
    want = plain([*texts, texts[9], texts[11]])
    got = [(r.doc_id, *numbers(r)) for r in al.alignment(docs)[0].collect()]
    assert sorted(got, key=repr) == sorted([(i, *w) for i, w in zip([*range(len(texts)), 9, None], want, strict=True)], key=repr)
    monkeypatch.setattr(al, "BROADCAST_PAIRS", 3)
    assert sorted(((r.doc_id, *numbers(r)) for r in al.alignment(docs)[0].collect()), key=repr) == sorted(got, key=repr)
    assert al.alignment(docs.limit(0))[0].count() == 0


def test_words_are_forgotten_and_pairs_handed_on(monkeypatch):
    import pyarrow as pa

    def collected():
        al.words_known.cache_clear()
        align = al.aligner(*(public_tokenizers.path(f) for f in (al.A_FILE, al.A_RANKS, al.B_FILE)))
        texts = [f"some words {i} and others " * 5 for i in range(40)]
        out = pa.Table.from_batches(align(iter([pa.record_batch([range(40), range(40), texts], names=["doc_id", "row", "text"])]))).to_pylist()
        pairs = Counter()
        for r in out:
            if r["row"] is None:
                pairs.update({(a, b): n for a, b, n in zip(r["a"], r["b"], r["n"], strict=True)})
        return [r for r in out if r["row"] is not None], pairs

    want = collected()
    for name, value in (("CHUNK", 100), ("WORDS", 3), ("TASK_PAIRS", 2)):
        monkeypatch.setattr(al, name, value)
    assert collected() == want


def test_query_on_all_documents(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()
    got = {r.doc_id: numbers(r) for r in QUERIES["op13_alignment"](spark, data).collect()}
    every = spark.read.parquet(f"{data}/documents.parquet").count()
    assert len(got) == every
    # numbers of the text alone; the corpus-wide ones are held above
    for r, want in zip(docs, plain([d.text for d in docs]), strict=True):
        assert got[r.doc_id][:4] + got[r.doc_id][6:] == want[:4] + want[6:]
