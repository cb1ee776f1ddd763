import random
import re

from assayer.llm.decontamination import leaks
from assayer.llm.queries import ORACLES, QUERIES

from ..oracle import duck, rows

DATA = "/root/testdata/sf0.001"


def parts(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def held(item, text):
    """(shingles of the item that the text holds, shingles of the item); an item of one to four words is one shingle."""
    own, words = ([w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in (item, text))
    if 0 < len(own) < 5:
        return int(any(words[i : i + len(own)] == own for i in range(len(words)))), 1
    return len(parts(item) & parts(text)), len(parts(item))


def test_leaks_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(400))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 17, 40])))) for i in range(40)] + [(90, None), (91, "")]
    docs = [(1, None, 0), (2, "", 0), (3, "one two", 0), (None, items[5][1], 0)]
    for n in range(120):
        words = [word() for _ in range(rng.choice([20, 300, 4000]))]
        own = items[n % 40][1].split()
        for _ in range(n % 3):
            own[rng.randrange(len(own))] = "other"
        words[10:10] = own
        docs.append((10 + n, " ".join(words).title(), 0))
    docs += [docs[5]] * 2
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, text, _ in docs:
        for i, item in items:
            matched, total = held(item, text)
            if total and matched / total >= 0.8:
                want.append((d or -1, i, matched, total))
    assert {n for _, _, _, n in want} >= {1, 5, 13}
    assert sorted((r.doc_id or -1, r.item_id, r.matched, r.total) for r in got) == sorted(want)


def test_query_equals_its_sql(spark):
    assert rows(QUERIES["op7_decontamination"](spark, DATA).toPandas()) == rows(duck(ORACLES["op7_decontamination"], DATA))
    assert leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
