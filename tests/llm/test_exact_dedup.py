import hashlib

from assayer.llm.exact_dedup import exact_duplicates


def test_exact_duplicates_against_brute_force(spark):
    texts = [None, "", "Abc", "aBC", "ÄB", "äb", "Äb", "x" * 300_000, "X" * 300_000, "one", "two", *(f"t{i % 40}" for i in range(100))]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(4, "ÄB", "a", "b")] * 2 + [(None, "one", "", "")]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row string, kept string")).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_no_rows_and_only_copies(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    assert exact_duplicates(docs.limit(0)).count() == 0
    got = exact_duplicates(docs).collect()
    assert [r.doc_id for r in got if r.kept] == [49] and {r.group_size for r in got} == {50}
