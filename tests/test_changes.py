"""The one-to-one matching and the classes of a diff against a plain greedy choice over all pairs."""

import random
import re

from assayer.functions.scalars import FILE_NAMES
from assayer.operators import changes

SCHEMA = "id long, category string, severity string, file string, start_line int, end_line int, title string, fixed boolean"


def words(title):
    t = re.sub(r"`[^`]*`", " ", (title or "").lower())
    t = re.sub(FILE_NAMES, " ", t)
    return re.sub(r"[^a-z]+", " ", t).split()


def alike(a, b):
    x, y = set(words(a)), set(words(b))
    return bool(x and y) and (words(a) == words(b) or len(x & y) / len(x | y) >= 0.6)


def gap(c, p):
    if c["start_line"] is None or p["start_line"] is None:
        return 0 if c["start_line"] is None and p["start_line"] is None else None
    return max(0, p["start_line"] - c["end_line"], c["start_line"] - p["end_line"])


def near(c, p):
    g = gap(c, p)
    return g * 2 + (not alike(c["title"], p["title"])) if c["file"] and c["file"] == p["file"] and g is not None and g <= 3 else None


def greedy(current, previous):
    left, other, pairs = {c["id"]: c for c in current}, {p["id"]: p for p in previous}, []
    for rank in (near, lambda c, p: 0 if c["file"] and c["file"] == p["file"] and alike(c["title"], p["title"]) else None, lambda c, p: 0 if alike(c["title"], p["title"]) else None):
        found = sorted((r, c, p) for c in left for p in other if left[c]["category"] == other[p]["category"] and (r := rank(left[c], other[p])) is not None)
        for _, c, p in found:
            if c in left and p in other:
                pairs.append((c, p))
                del left[c], other[p]
    return pairs, list(left.values()), list(other.values())


def run(rng, first, n):
    names = ["alpha", "beta", "gamma", "delta"]
    out = []
    for i in range(first, first + n):
        line = rng.choice([None, rng.randrange(1, 30)])
        title = rng.choice([None, "", "`x`", f"Missing {rng.choice(names)} in src/a.ts:{i} for {rng.choice(names)} {rng.choice(names)}"])
        out.append({"id": i, "category": rng.choice(["auth", "config"]), "severity": rng.choice(["HIGH", "LOW"]), "file": rng.choice([None, "a.ts", "b.ts"]), "start_line": line, "end_line": line and line + rng.randrange(3), "title": title, "fixed": rng.random() < 0.2})
    return out


def plain_classes(current, previous, older):
    pairs, fresh, gone = greedy(current, previous)
    c, p = {x["id"]: x for x in current}, {x["id"]: x for x in previous}
    rows = []
    for a, b in pairs:
        kind = "still_fixed" if c[a]["fixed"] and p[b]["fixed"] else "fixed" if c[a]["fixed"] else "regressed" if p[b]["fixed"] else "unchanged"
        rows.append((a, kind, b))
        if not c[a]["fixed"] and c[a]["severity"] != p[b]["severity"]:
            rows.append((a, "severity_changed", b))
    rest = [x for x in fresh if not x["fixed"]]
    again, rest, _ = greedy(rest, older)
    rows += [(a, "regressed", b) for a, b in again] + [(x["id"], "new", None) for x in [*rest, *(x for x in fresh if x["fixed"])]]
    return rows + [(None, "still_fixed" if x["fixed"] else "fixed", x["id"]) for x in gone]


def test_diff_against_all_pairs(spark):
    rng = random.Random(12)
    current, previous, older = run(rng, 0, 40), run(rng, 1000, 45), run(rng, 2000, 30)
    frames = [spark.createDataFrame(x, SCHEMA) for x in (current, previous, older)]
    assert sorted((r.c, r.p) for r in changes.match_findings(*frames[:2]).collect()) == sorted(greedy(current, previous)[0])
    got = changes.classify(frames[0], frames[1], frames[2:]).collect()
    assert sorted(map(str, ((r.id, r["class"], r.was) for r in got))) == sorted(map(str, plain_classes(current, previous, older)))


def test_empty_runs_and_partial_audits(spark):
    rows = run(random.Random(1), 0, 5)
    some, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert changes.match_findings(none, some).count() == 0 and changes.match_findings(some, none).count() == 0
    gone = changes.classify(none, some, [], partial=True).collect()
    assert sorted(r["class"] for r in gone) == sorted("still_fixed" if x["fixed"] else "not_rechecked" for x in rows)
    assert {r["class"] for r in changes.classify(some, none, []).collect()} == {"new"}


def test_queries_give_the_plain_pairs(spark):
    data = "/root/testdata/sf0.001"
    current, previous, older = ([r.asDict() for r in df.collect()] for df in changes._runs(spark, data))
    assert sorted((r.c, r.p) for r in changes.matched_findings(spark, data).collect()) == sorted(greedy(current, previous)[0])
    got = changes.audit_diff(spark, data).collect()
    assert sorted(map(str, ((r.id, r["class"], r.was) for r in got))) == sorted(map(str, plain_classes(current, previous, older)))


def test_equal_findings_take_few_steps(spark, monkeypatch):
    steps, plain = [], changes.checkpointed
    monkeypatch.setattr(changes, "checkpointed", lambda df: steps.append(1) or plain(df))
    row = {"category": "auth", "severity": "LOW", "file": "a.ts", "start_line": 3, "end_line": 3, "title": "Missing check", "fixed": False}
    counts = []
    for n in (20, 2000):
        steps.clear()
        current = spark.createDataFrame([{"id": i, **row} for i in range(n)], SCHEMA)
        previous = spark.createDataFrame([{"id": 10_000 + i, **row, "file": "a.ts" if i % 2 else "b.ts"} for i in range(n)], SCHEMA)
        got = sorted((r.c, r.p) for r in changes.match_findings(current, previous).collect())
        near = [10_000 + i for i in range(n) if i % 2]
        assert got == list(zip(range(n), near + [10_000 + i for i in range(n) if i % 2 == 0], strict=True))
        counts.append(len(steps))
    assert counts[0] == counts[1]


def test_matching_with_many_ties(spark):
    rng = random.Random(31)
    for _ in range(3):
        two = []
        for first in (0, 1000):
            rows = run(rng, first, 60)
            for r in rows:
                r["title"] = rng.choice(["missing check alpha", "missing check alpha beta", "missing check beta", "missing check", "gone"])
            two.append(rows)
        frames = [spark.createDataFrame(x, SCHEMA) for x in two]
        assert sorted((r.c, r.p) for r in changes.match_findings(*frames).collect()) == sorted(greedy(*two)[0])


def test_files_are_matched_within_tasks_and_crowded_ones_by_kinds(spark, monkeypatch):
    """Four files of 30 findings each meet in no join of kinds unless they are too crowded, and give the same pairs either way."""
    seen = []
    for name in ("_near", "_same_file", "_same_title"):
        monkeypatch.setattr(changes, name, lambda a, b, titles, plain=getattr(changes, name): seen.append(1) or plain(a, b, titles))
    rng = random.Random(5)
    two = [run(rng, first, 60) for first in (0, 1000)]
    frames, want = [spark.createDataFrame(x, SCHEMA) for x in two], sorted(greedy(*two)[0])
    assert sorted((r.c, r.p) for r in changes.match_findings(*frames).collect()) == want and not seen
    for most in (0, 30):
        monkeypatch.setattr(changes, "CELL_ROWS", most)
        assert sorted((r.c, r.p) for r in changes.match_findings(*frames).collect()) == want and seen
