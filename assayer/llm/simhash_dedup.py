"""Near duplicates by SimHash fingerprints and vantage-point trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, digest, small, table, text_of
from .components import connected
from .similar import TALLY, common, components_of, tallied
from .words import Words, blocks_of, first_of_each, runs, shingle_keys, simhashes, words_of

#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 15


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64 bits that are set in over half the XXH64 of the text's shingles. No words: 0. bytes.lower and bytes.split know ASCII only."""
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    shingles = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) > words else iter([tuple(tokens)])
    count = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = (digest(join(s), seed) for s in shingles)
    for start in range(0, count, BLOCK):
        block = np.fromiter(hashes, dtype=">u8", count=min(BLOCK, count - start))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def tree(sample: np.ndarray, radius: int, leaf: int, depth: int = 40) -> dict[int, tuple[int, int]]:
    """A vantage-point tree over a sample: (vantage point, distance) by the number of each inner node; the children of n are 2n + 1 and 2n + 2.

    The vantage point of a node is its fingerprint farthest from the first one, which spreads the distances most.
    """
    nodes: dict[int, tuple[int, int]] = {}
    todo = [(0, sample)]
    while todo:
        at, points = todo.pop()
        if len(points) <= leaf or at >> depth:
            continue
        vantage = points[distance(points, points[0]).argmax()]
        far = distance(points, vantage)
        cut = int(np.median(far))
        near = far <= cut
        if near.all():
            cut, near = cut - 1, far <= cut - 1
        # cells that hardly part are left whole: a split would repeat nearly all their rows
        if not near.any() or (near & (far > cut - radius)).sum() > 0.6 * len(points):
            continue
        nodes[at] = (int(vantage), cut)
        todo += [(2 * at + 1, points[near]), (2 * at + 2, points[~near])]
    return nodes


def cells(points: np.ndarray, nodes: dict[int, tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, cell) for each cell a point has to be in so that all pairs within radius meet in one.

    Of a pair on either side of a boundary the inner one is at most radius away from it: if d(far, v) > cut, then by the
    triangle bound d(near, v) > cut - radius. So inner points of that margin go to both sides.
    """
    done_at, done_cell = [], []
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, index = todo.pop()
        if not len(index):
            continue
        if at not in nodes:
            done_at.append(index)
            done_cell.append(np.full(len(index), at))
            continue
        vantage, cut = nodes[at]
        far = distance(points[index], np.uint64(vantage))
        todo += [(2 * at + 1, index[far <= cut]), (2 * at + 2, index[far > cut - radius])]
    return np.concatenate(done_at or [np.empty(0, int)]), np.concatenate(done_cell or [np.empty(0, int)])


def flips(radius: int) -> list[int]:
    """All 64-bit masks of 1 to radius bits."""
    masks, level = [], [0]
    for _ in range(radius):
        level = sorted({m | 1 << b for m in level for b in range(64) if not m >> b & 1})
        masks += level
    return masks


def links(points: np.ndarray, radius: int, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct points within radius that connect what all such pairs connect: each point with the least of its cell's cluster."""
    points = np.unique(points)
    root = np.arange(len(points))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)

    at, cell = cells(points, tree(points, radius, leaf), radius)
    order = np.lexsort((at, cell))
    at, cell = at[order], cell[order]
    masks: list[int] = []
    for own in np.split(at, np.flatnonzero(np.diff(cell)) + 1):
        inside = points[own]
        if len(own) <= 2048:
            a, b = np.nonzero(np.triu(distance(inside[:, None], inside[None, :]) <= radius, 1))
            join(zip(own[a].tolist(), own[b].tolist(), strict=True))
        else:  # a crowd: looking up all flips of each point takes less than comparing all with all
            masks = masks or flips(radius)
            for mask in masks:
                other = inside ^ np.uint64(mask)
                place = np.searchsorted(inside, other)
                place[place == len(inside)] = 0
                hit = np.flatnonzero((inside[place] == other) & (inside < other))
                join(zip(own[hit].tolist(), own[place[hit]].tolist(), strict=True))
    least = np.array([find(x) for x in range(len(points))], dtype=int)
    away = np.flatnonzero(least != np.arange(len(points)))
    return points[away], points[least[away]]


def signed(points: np.ndarray) -> np.ndarray:
    return points.view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3, sample: int = 20_000, cell_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id it is linked with, itself included).

    Documents whose fingerprints differ in at most radius bits are linked, and so is what links lead to. Equal
    fingerprints are one point. A vantage-point tree over a bounded sample of points (sample) parts them into cells of about
    cell_rows; points within radius of a boundary go to both sides, so each close pair meets in a cell. Each cell
    has a tree of its own, and gives a spanning forest of its links, never all pairs. Components over all cells are found
    by joins. The sample decides on the speed only.

    Texts are read whole. Null and empty texts and those without words have fingerprint zero, linked like any other.
    Rows with a null doc_id get the component of their fingerprint; rows with equal ids each have a row. An empty
    table gives no rows. Other columns are ignored.
    """

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(signed(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))))

    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), simhash(text_of(text_col)).alias("point")))
    points = checkpointed(rows.groupBy("point").agg(F.min("doc_id").alias("first")))
    count = points.count()
    if not count:
        return rows.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    edges = cell_links(points.select("point"), count, radius, sample, cell_rows)
    found = connected(edges)
    if found is None:
        labelled = points.withColumnRenamed("first", "component_id")
    else:
        placed = points.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
        labelled = placed.join(placed.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("point", "component_id")
    return rows.join(labelled, "point").select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def cell_links(points: DataFrame, count: int, radius: int, sample: int = 20_000, cell_rows: int = 20_000) -> DataFrame:
    """Links (a, b) of points within radius, found cell by cell."""
    share = min(1.0, sample / count)
    drawn = points.where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else points
    leaf = max(16, int(cell_rows * share))
    drawn = np.sort(np.array([r.point for r in drawn.collect()], np.int64)).view(np.uint64)
    nodes = tree(drawn, radius, leaf)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["point"].to_numpy(np.int64).view(np.uint64)
            at, cell = cells(own, nodes, radius)
            yield pd.DataFrame({"cell": cell, "point": signed(own[at])})

    def linked(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = links(batch["point"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": signed(a), "b": signed(b)})

    dealt = points.mapInPandas(deal, "cell long, point long")
    return dealt.groupBy("cell").applyInPandas(linked, "a long, b long")


def words_key(text: F.Column) -> F.Column:
    """Two hashes (k1, k2) of the sequence of the text's words in lower case, both 0 if there are none."""

    @F.pandas_udf("k1 long, k2 long")
    def key(texts: pd.Series) -> pd.DataFrame:
        blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        parts = [described(words, begin)[:2] for words, begin in word_blocks(blobs)]
        return pd.DataFrame(np.concatenate([np.stack(p, axis=1) for p in parts] or [np.zeros((0, 2), np.int64)]), columns=["k1", "k2"])

    return key(text)


def word_blocks(blobs: list[bytes]) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of texts, block by block, and where in them each text begins and the last one ends."""
    for first, last in blocks_of([len(b) for b in blobs]):
        # line breaks part texts only
        words = words_of(b"\n".join(b.replace(b"\n", b" ") for b in blobs[first:last]), letters=False)
        yield words, np.searchsorted(words.line, np.arange(last - first + 1))


def described(words: Words, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, first word, number of words) of each text."""
    starts, ends = begin[:-1], begin[1:]
    keys = [np.where(ends > starts, runs(h, starts, ends).view(np.int64), 0) for h in (words.hashes, words.hashes * np.uint64(0x94D049BB133111EB) + np.uint64(1))]
    return *keys, starts, ends - starts


def near_copies(docs: DataFrame, text_col: str = "text", similarity: float = 0.8, words: int = 5, radius: int = 2) -> DataFrame | None:
    """(k1, k2, component) of the texts that are not by themselves: words_key of a text, and its group; None if there are none.

    Texts are linked whose shingles of words words (of a shorter text the one of all its words) have a Jaccard
    similarity of so much or more; a group is what links connect. Fingerprints of the shingles and vantage-point trees find
    most pairs; as no radius that leaves cells holds all pairs of that similarity, an exact search follows: two such
    texts share one of the first n - ceil(similarity * n) + 1 of their n shingles in one order of all. All pairs are verified
    by their shingles, those of fingerprints too. Texts with the same words are one; texts without words are compared with none.
    """

    def arrays(batches: Iterator[pa.RecordBatch], marks: np.ndarray | None, prefix: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, at = [t.lower().encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], 0
            for part, begin in word_blocks(blobs):
                k1, k2, starts, counts = described(part, begin)
                tags, at = batch.column("tag").slice(at, len(counts)), at + len(counts)
                every, own = shingle_keys(part, starts, counts, words, marks)
                keys, run = first_of_each(every, own)
                n = np.bincount(run, minlength=len(counts))
                held = np.bincount(own, minlength=len(counts))
                full = np.flatnonzero(held)
                point = np.zeros(len(counts), np.int64)
                point[full] = simhashes(every * np.uint64(0x9E3779B97F4A7C15) ^ every >> np.uint64(31), (np.cumsum(held) - held)[full], held[full]).view(np.int64)
                if prefix:
                    keys, run = first_of_each(keys, run, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(counts)))]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([tags, pa.array(k1), pa.array(k2), pa.array(point), pa.array(n.astype(np.int32)), shingles], names=["tag", "k1", "k2", "point", "n", "shingles"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            blobs = [t.lower().encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for part, begin in word_blocks(blobs):
                _, _, starts, counts = described(part, begin)
                yield first_of_each(*shingle_keys(part, starts, counts, words))[0]

    schema = "tag {}, k1 long, k2 long, point long, n int, shingles array<long>"
    texts = docs.select(text_of(text_col).alias("text"))
    marks = common(texts, lambda some: some.mapInArrow(lambda b: tallied(keys(b)), TALLY))
    tagged = texts.withColumn("tag", digest(F.col("text")))
    described_texts = tagged.mapInArrow(lambda b: arrays(b, marks, True), schema.format("binary")).where("n > 0")
    known = described_texts.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("tag", "point", "n", "shingles")))
    known = checkpointed(known.withColumn("node", F.monotonically_increasing_id()))

    def holds(pairs: DataFrame) -> DataFrame:
        # one text of each node is found again by its digest, so that a task needs one Python worker and not a second one for keys
        wanted = small(known.join(small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node").select("tag", "node"))
        held = tagged.join(wanted, "tag").select("text", F.col("node").alias("tag"))
        own = held.mapInArrow(lambda b: arrays(b, marks, False), schema.format("long")).select(F.col("tag").alias("node"), "n", "shingles")
        own = own.dropDuplicates(["node"])  # one shuffle, by node, serves both joins
        sides = [own.select(F.col("node").alias(a), F.col("n").alias(n), F.col("shingles").alias(x)) for a, n, x in (("a", "m", "x"), ("b", "n", "y"))]
        both = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("m", "n") >= F.greatest("m", "n") * similarity - 1e-9)
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= (F.col("m") + F.col("n") - shared) * similarity - 1e-9).select("a", "b")

    points = checkpointed(known.groupBy("point").agg(F.min("node").alias("first")))
    if not (count := points.count()):
        return None
    close = cell_links(points.select("point"), count, radius)
    first = points.select(F.col("point").alias("p"), "first")
    ends = close.join(first.select(F.col("p").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("p").alias("b"), F.col("first").alias("y")), "b")
    same = known.join(points, "point").where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = checkpointed(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same).distinct())
    buckets = known.select("node", F.explode("shingles").alias("bucket"))
    traits = known.select("node", F.struct("n").alias("t"))
    sizes = lambda t, u: F.least(t["n"], u["n"]) >= F.greatest(t["n"], u["n"]) * similarity - 1e-9
    groups = components_of(buckets, holds, traits, sizes, holds(pairs))
    return None if groups is None else known.select("k1", "k2", "node").join(small(groups), "node").select("k1", "k2", "component")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
