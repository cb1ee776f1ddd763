import random

import numpy as np
import xxhash

from assayer.llm import simhash_dedup
from assayer.llm.components import connected
from assayer.llm.simhash_dedup import cell_links, fingerprint, links, near_duplicates, signed


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(n, pairs):
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def clustered(rng, centres, around, noise):
    points = [rng.getrandbits(64) for _ in range(noise)]
    for _ in range(centres):
        c = rng.getrandbits(64)
        points += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(around)]
    return np.unique(np.array(points, np.uint64))


def partition(points, a, b):
    at = {int(p): i for i, p in enumerate(points)}
    return components(len(points), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)])


def brute(points):
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    return components(len(points), zip(*np.nonzero(np.triu(close, 1)), strict=True))


def test_links_against_all_pairs():
    rng = random.Random(3)
    for centres, around, noise in ((0, 0, 0), (0, 0, 1), (0, 0, 900), (40, 30, 500), (1, 3000, 100)):
        points = clustered(rng, centres, around, noise)
        assert partition(points, *links(points, 2, 16)) == brute(points)


def test_cells_over_executors_lose_no_link(spark):
    points = clustered(random.Random(4), 60, 20, 800)
    df = spark.createDataFrame([(int(p),) for p in signed(points)], "point long")
    got = cell_links(df, len(points), 2, 200, 50).toPandas()
    assert partition(points, got.a.to_numpy(np.int64).view(np.uint64), got.b.to_numpy(np.int64).view(np.uint64)) == brute(points)


def test_connected(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(200, 300)] + [(0, x) for x in range(1, 60)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(600, pairs)
    assert got == {n: want[n] for n in {x for a, b in pairs if a != b for x in (a, b)}}
    assert connected(spark.createDataFrame([], "a long, b long")) is None


def test_fingerprint_of_known_texts(spark):
    for text in ("", " \n", "one", "A b", "A\x0bb\x1cc d É É", "é " * 9, "word " * 70_000):
        assert fingerprint(text) == slow_fingerprint(text)
    rows = spark.createDataFrame([("one two three",)], "t string").selectExpr("xxhash64(t) AS h").first()
    assert rows.h & (1 << 64) - 1 == fingerprint("ONE two three")


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=rng.choice([2, 30, 300]))) for _ in range(60)]
    texts = [None, "", "  ", *base, *base[:20], *(t.upper() for t in base[20:30]), *(f"{t} end" for t in base)]
    rows = [(i, t, "f", "p") for i, t in enumerate(texts)] + [(3, base[0], "", "")] * 2 + [(None, base[1], "", "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, point string"), sample=50, cell_rows=20).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(t or "") for _, t, *_ in rows]
    root = brute(np.array(prints, np.uint64)) if len(prints) else []
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        least[r] = min(i if i is not None else 10**9, least.get(r, 10**9))
    want = sorted((str(i), f"{p:016x}", least[r]) for (i, *_), p, r in zip(rows, prints, root, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) < len(texts) - 30
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowds_are_dealt_out(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    crowd = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    points = np.array(sorted(crowd), np.uint64)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    for radius in (1, 2):
        got = cell_links(frame, len(points), radius, sample=200, cell_rows=40).toPandas()
        near = [(i, j) for i in range(len(points)) for j in range(i) if int(points[i] ^ points[j]).bit_count() <= radius]
        place = {int(p): n for n, p in enumerate(points.view(np.int64))}
        assert components(len(points), near) == components(len(points), [(place[a], place[b]) for a, b in zip(got.a.tolist(), got.b.tolist())])
        assert len(near) > 20


def test_candidates_are_read_by_one_python_worker_a_task(spark, monkeypatch):
    """Texts of candidates are found by their digest; a second function of Python beside that for shingles took an executor's memory."""
    monkeypatch.setattr(simhash_dedup, "words_key", lambda text: 1 / 0)
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(base,), (base.upper(),), (f"{base} end",), ("others stand here alone",), (None,)], "text string")
    got = simhash_dedup.near_copies(docs).collect()
    assert len(got) == 2 and len({r.component for r in got}) == 1
