import random
import re

import numpy as np

from assayer.llm.words import blocks_of, cleaned, first_of_each, runs, shingle_keys, simhashes, words_of

TEXTS = ["The Cat\tsat -- on the MAT.\n\n  été ÉTÉ naïve\x0bx_1\n", "", "\n\n", "¿Qué? “el gato” 日本 語\nthe cat sat", "ſtraße İstanbul a\u0301b", "x" * 3000 + " the cat\u2028sat"]


def plain(line):
    return re.findall(r"[^\W_]+", line)


def test_words_and_lines_equal_the_plain_ones():
    lines = [line for t in TEXTS for line in t.lower().split("\n")]
    words = words_of(b"\n".join(map(cleaned, TEXTS)))
    assert words.lines == len(lines)
    want = [(n, w) for n, line in enumerate(lines) for w in plain(line)]
    assert words.line.tolist() == [n for n, _ in want] and words.sizes.tolist() == [len(w.encode()) for _, w in want]
    by_word = {}
    for (_, w), h in zip(want, words.hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    line, first, count = words.grouped()
    assert [(a, c) for a, c in zip(line, count)] == [(n, len(plain(x))) for n, x in enumerate(lines) if plain(x)]
    same = dict(zip([" ".join(plain(lines[n])) for n in line], runs(words.hashes, first, first + count).tolist()))
    assert len(set(same.values())) == len(same)


def test_words_between_white_space():
    text = "The cat, sat\x0b\x0c on\r\n\tthe-mat \u00a0 É"
    assert len(words_of(text.encode(), letters=False).hashes) == len(text.encode().split())


def test_simhash_equals_the_plain_count():
    rng = random.Random(1)
    counts = np.array([1, 2, 8, 255, 256, 510, 511, 3000])
    lines = [[rng.getrandbits(64) for _ in range(n)] for n in counts]
    flat = np.array([h for own in lines for h in own], np.uint64)
    want = [sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) for h in lines]
    assert simhashes(flat, np.cumsum(counts) - counts, counts).tolist() == want
    assert simhashes(flat[:0], counts[:0], counts[:0]).tolist() == []


def test_shingles_and_the_first_of_each():
    texts = ["a bb ccc dddd a bb ccc", "a bb", "zz a bb ccc", "a bb ccc a bb ccc a bb ccc"]
    words = words_of("\n".join(texts).encode())
    _, starts, counts = words.grouped()
    keys, run = first_of_each(*shingle_keys(words, starts, counts, 3))
    of = [set(keys[run == n].tolist()) for n in range(4)]
    plain_of = [{tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))} for t in texts]
    assert [[len(a & b) for a in of] for b in of] == [[len(a & b) for a in plain_of] for b in plain_of]
    few, own = first_of_each(*shingle_keys(words, starts, counts, 3), 2)
    assert all(sorted(few[own == n].tolist()) == sorted(of[n])[:2] for n in range(4))


def test_blocks_hold_every_text_once():
    sizes = [10, 0, 1 << 20, 3, 1 << 22, 5, 0]
    got = list(blocks_of(sizes))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes))) and len(got) > 2
    assert list(blocks_of([])) == []
