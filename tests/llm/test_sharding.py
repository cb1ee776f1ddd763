import zlib

from pyspark.sql import functions as F

from assayer.llm.sharding import STEP, jump_hash, shards


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * STEP + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_algorithm(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), 10863919174838991, *range(-500, 500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k & (1 << 64) - 1, n) for k in keys}


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else f"tëxt {i} " * (i % 9), "x", i) for i in range(2000)] + [(None, "a", "x", 0)] * 2 + [(5, "again", "x", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, row long")
    got = shards(docs, rows_per_group=10).collect()
    assert len(got) == len(rows)
    texts = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got)
    assert texts == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for n in range(16):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert 60 < sum(r.grown_shard == 16 for r in got) < 180
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert shards(docs.limit(0)).count() == 0
