"""Importance resampling towards a target distribution: weights from an array of gains, then sorted runs merged by tournament trees."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, text_of

#: Fixed value: what a word is, in UTF-8, once A-Z are in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words whose buckets a worker remembers, and their length at most.
KNOWN_WORDS, KNOWN_LENGTH = 500_000, 40
#: Ranges of the drawn order that there are at most, rows of a range below that, and sampled rows for each range.
RANGES, RANGE_ROWS, SAMPLED = 2000, 20_000, 32


class Buckets(dict):
    """word -> bucket by the CRC-32 of its UTF-8 bytes; forgets all when it has grown to KNOWN_WORDS."""

    def __init__(self, count: int, most: int):
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % self.count
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = bucket
        return bucket

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """The number of words, and the buckets of all runs of 1 to `most` consecutive words. bytes.lower() changes A-Z only."""
        words = WORD.findall(text.encode().lower())
        longer = [b" ".join(words[i : i + n]) for n in range(2, self.most + 1) for i in range(len(words) - n + 1)]
        return len(words), np.fromiter(map(self.__getitem__, words + longer), np.int64, len(words) + len(longer))


def bucket_counts(texts: DataFrame, column: str, buckets: int, most: int) -> np.ndarray:
    """How many features of all texts lie in each bucket. Tasks add up arrays of their own; the driver sees one number a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = Buckets(buckets, most), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch[column]:
                np.add.at(total, held.of(text)[1], 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "features": total[used]})

    counted = texts.select(text_of(column).alias(column)).mapInPandas(count, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features")).collect()
    out = np.zeros(buckets, np.int64)
    for row in counted:
        out[row.bucket] = row.features
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets."""
    buckets = len(source)
    above = (target + 1.0) * float(source.sum() + buckets)
    return np.floor(1000 * np.log(above / ((source + 1.0) * float(target.sum() + buckets)))).astype(np.int64)


def weights(gain: np.ndarray, most: int):
    """A column of texts -> words, features, and the sum of the features' gains."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Buckets(len(gain), most)
        for texts in batches:
            found = map(held.of, texts)
            yield pd.DataFrame([(words, len(of), int(gain[of].sum())) for words, of in found], columns=["n_words", "n_features", "weight"])

    return weigh


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of `seed:id`; a null id is the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


class Tournament:
    """Merges sorted sequences by a tree of losers: an inner node keeps who lost there, so the next least is found in one walk from a leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _head(self, run: int) -> tuple | None:
        return self.heads[run] if 0 <= run < len(self.heads) else None

    def _ahead(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; runs that have ended go last."""
        left, right = self._head(a), self._head(b)
        return left is not None and (right is None or left <= right)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._ahead(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while (head := self._head(self.winner)) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.size) >> 1
            while node:
                if self._ahead(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node >>= 1
            self.winner = run


#: A row's place in the drawn order: highest score, a doc_id, the least doc_id, and the row for those that are alike.
KEY = ["best", "no_id", "id", "row"]


def drawn_runs(eligible: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Each partition as a sorted run, cut at the splitters: a row (range, size, and arrays of the key and payload) for each piece of an Arrow batch in a range."""
    names = eligible.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
            starts, ranges, at = [], [], 0
            while at < len(keys):
                starts.append(at)
                ranges.append(bisect_right(splitters, keys[at]))
                at = bisect_left(keys, splitters[ranges[-1]], at) if ranges[-1] < len(splitters) else len(keys)
            edges = pa.array([*starts, len(keys)], pa.int32())
            lists = [pa.ListArray.from_arrays(edges, batch.column(name)) for name in names]
            sizes = np.diff(np.array([*starts, len(keys)])).astype(np.int64)
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(sizes), *lists], names=["range", "size", *names])

    types = dict(eligible.dtypes)
    order = [F.col(k) for k in KEY]
    return eligible.sortWithinPartitions(*order).mapInArrow(cut, ", ".join(["`range` long, `size` long", *(f"`{n}` array<{types[n]}>" for n in names)]))


def drawn(scored: DataFrame, percent: int) -> tuple[DataFrame | None, tuple | None]:
    """The floor(percent N / 100) first of the eligible rows with their rank from 1, and the key of the last one.

    Runs are written to the shared folder in pieces by range of the order, where a range is some RANGE_ROWS rows; splitters come
    from SAMPLED rows of each. The counts of the pieces say where each range begins and which lie beyond the draw. A task then merges
    the pieces of one range by a tournament tree, and stops at the last row that is drawn.
    """
    eligible = scored.where("eligible").select((-F.col("score")).alias("best"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row", "n_features", "weight")
    # Python compares the keys, so a missing id stands as the least value of its type; no_id has put it last before
    nothing = F.lit(0 if dict(eligible.dtypes)["id"] != "string" else "")
    eligible = eligible.withColumn("id", F.coalesce("id", nothing.cast(eligible.schema["id"].dataType)))
    count = eligible.count()
    take = count * percent // 100
    if not take:
        return None, None
    rows = max(RANGE_ROWS, -(-count // RANGES))
    ranges = -(-count // rows)
    every = max(1, rows // SAMPLED)
    sample = sorted(tuple(r) for r in eligible.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select(*KEY).collect())
    splitters = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else []
    runs = checkpointed(drawn_runs(eligible, sorted(set(splitters))))
    starts, before = {}, 0
    for r in sorted(runs.groupBy("range").agg(F.sum("size").alias("size")).collect(), key=lambda r: r["range"]):
        if before >= take:
            break
        starts[r["range"]], before = before, before + r["size"]
    names = eligible.columns

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        start = starts[key[0].as_py()]
        columns = [pieces.column(n).combine_chunks() for n in names]
        lists = [zip(*(c[i].values.to_pylist() for c in columns), strict=True) for i in range(len(pieces))]
        out = []
        for rank, row in enumerate(Tournament(lists), start + 1):
            if rank > take:
                break
            out.append((*row, rank))
        of_type = pieces.schema
        values = list(zip(*out, strict=True))
        return pa.Table.from_arrays([*(pa.array(v, of_type.field(n).type.value_type) for n, v in zip(names, values, strict=False)), pa.array(values[-1], pa.int64())], names=[*names, "rank"])

    types = dict(eligible.dtypes)
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), "`rank` long"])
    merged = checkpointed(runs.where(F.col("range").isin(list(starts))).groupBy("range").applyInArrow(merge, schema))
    return merged, tuple(merged.where(F.col("rank") == take).select(*KEY).first())


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, most: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    Features are runs of 1 to `most` words, put into buckets by hash. A bucket's gain is the logarithm of its share in target to its
    share in docs; a document's weight sums the gains of its features, its score adds Gumbel noise from its id, and the percent of
    the documents with least_words words or more that score highest are drawn, ties going to the smaller doc_id (null ones last,
    then by row). rank is null for those not drawn. Which rows are drawn is told by the last drawn one's key alone, so undrawn ones aren't
    shuffled.

    Null and empty texts have no features and weight 0. Repeated rows each have a rank of their own. An empty table gives no rows; an
    empty target has even shares. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, most), bucket_counts(target, target_col, buckets, most))
    weighed = docs.select(F.col(id_col).alias("doc_id"), weights(gain, most)(text_of(text_col)).alias("w"))
    score = (F.col("w.weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = weighed.select("doc_id", "w.n_features", "w.weight", score, (F.col("w.n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("row"))
    scored = checkpointed(scored)
    ranked, last = drawn(scored, percent)
    if ranked is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    kind = scored.schema["doc_id"].dataType
    nothing = F.lit(0 if dict(scored.dtypes)["doc_id"] != "string" else "").cast(kind)
    key = F.struct((-F.col("score")).alias("best"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", nothing).alias("id"), F.col("row"))
    end = F.struct(F.lit(last[0]).cast("long").alias("best"), F.lit(last[1]).alias("no_id"), F.lit(last[2]).cast(kind).alias("id"), F.lit(last[3]).cast("long").alias("row"))
    rest = scored.where(~F.col("eligible") | (key > end)).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    top = ranked.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_features", "weight", (-F.col("best")).alias("score"), "rank")
    return top.unionByName(rest)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
