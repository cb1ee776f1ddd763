import random

from assayer.operators import php


def test_the_first_semicolon_that_is_not_deeper(spark, monkeypatch):
    """Held against all pairs, over blocks of few letters."""
    monkeypatch.setattr(php, "BLOCK", 16)
    rng = random.Random(3)
    semis = [(f"f{f}", pos, rng.randrange(-2, 6)) for f in range(4) for pos in rng.sample(range(400), 60)]
    places = [(f"f{f}", pos, rng.randrange(-3, 5)) for f in range(5) for pos in rng.sample(range(420), 50)]
    want = {(p, pos): min((s for q, s, level in semis if q == p and s > pos and level <= depth), default=None) for p, pos, depth in places}
    out = php.first_not_deeper(spark.createDataFrame(places, "path string, pos long, depth long"), spark.createDataFrame(semis, "path string, semi long, level long"))
    assert {(r.path, r.pos): r.semi for r in out.collect()} == {k: v for k, v in want.items() if v is not None}
