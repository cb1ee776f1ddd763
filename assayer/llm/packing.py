"""Bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, table, text_of

#: The id behind each document.
END = 0
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces of a capacity / TINY or less go in bundles of equal ones, of a quarter of the capacity at most.
TINY = 64
#: So many of the waiting documents, or more, have to fit a sequence for them to be dealt out by rank.
DEALT = 8


@cache
def encoder(ranks: str, full: str) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizers library's file `full`.

    The same vocabulary, ranks, is read by tiktoken, which gives the same ids in a fifth of the time, as the tests hold. Where it gives
    up, on a very long run of white space, the library itself is asked.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        by_token = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_token, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        try:
            return quick.encode(text, allowed_special="all")
        except ValueError:
            return library(full).encode(text, add_special_tokens=False).ids

    return encode


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, cut where there are more than capacity; the first piece is the one that may be shorter.

    Null and empty texts are one piece of one id. Rows are cut one by one, so repeated ones each have their pieces; other columns are ignored.
    path names another file of the tokenizers library.
    """
    import public_tokenizers

    full, ranks = path or public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks, full) if path is None else lambda t: library(full).encode(t, add_special_tokens=False).ids
        for texts in batches:
            out = []
            for text in texts:
                ids = np.array([*encode(text), END], "<u4")
                rest = len(ids) % capacity
                edges = [0, *range(rest or capacity, len(ids) + 1, capacity)]
                out.append([{"piece": n, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
            yield pd.Series(out)

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cut(text_of(text_col))).alias("p")).select("doc_id", "p.*")


def bundled(rows: DataFrame, counts: dict[int, int], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(items, members) of rows (id, size, rank): tiny rows of one size go in bundles of powers of two, the others are items by themselves.

    So a sequence isn't filled by hundreds of supersteps of one tiny row each. members: id, item, at (place in the item).
    """
    spark = rows.sparkSession
    cuts = []
    for size, n in counts.items():
        if size * TINY <= capacity:
            most = 1 << ((capacity // 4) // size).bit_length() - 1
            rest, own = n % most, [n - n % most]
            while rest:  # what is left goes in smaller powers of two
                own.append(own[-1] + (1 << rest.bit_length() - 1))
                rest -= 1 << rest.bit_length() - 1
            cuts.append((size, most, own))
    if not cuts:
        return rows.select("id", "size"), rows.select("id", F.col("id").alias("item"), F.lit(0).cast("long").alias("at"))
    own = F.broadcast(spark.createDataFrame(cuts, "size long, most long, cuts array<long>"))  # capacity / TINY rows at most
    start = F.when(F.col("rank") < F.col("cuts")[0], F.col("rank") - F.col("rank") % F.col("most")).otherwise(F.array_max(F.filter("cuts", lambda c: c <= F.col("rank"))))
    placed = rows.join(own, "size", "left").withColumn("start", start)
    # the items of rows have numbers from 0 on, those of bundles lie below
    item = F.when(F.col("start").isNull(), F.col("id")).otherwise(-F.col("size") * (1 << 48) - F.col("start") - 1)
    members = checkpointed(placed.select("id", "size", item.alias("item"), F.coalesce((F.col("rank") - F.col("start")) * F.col("size"), F.lit(0)).alias("at")))
    alone = members.where("item >= 0").select(F.col("item").alias("id"), "size")
    together = members.where("item < 0").groupBy(F.col("item").alias("id")).agg(F.sum("size").alias("size"))
    return alone.unionByName(together), members.select("id", "item", "at")


def ranked(state: DataFrame, groups: int) -> tuple[DataFrame, dict[tuple[bool, int], int]]:
    """state (kind, id, size) with rank, from 0 within its kind and size; and how many rows each kind and size has.

    Rows of a size are counted in groups, so that no size has to fit a task.
    """
    own = state.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)))
    counts = checkpointed(own.groupBy("kind", "size", "part").count())
    totals = {(r.kind, r.size): r.n for r in counts.groupBy("kind", "size").agg(F.sum("count").alias("n")).collect()}  # one row a size
    before = Window.partitionBy("kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("kind", "size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("kind", "size", "part").orderBy("id")) - 1
    starts = F.broadcast(starts) if len(totals) * groups <= BROADCAST_ROWS else starts
    return own.withColumn("within", within).join(starts, ["kind", "size", "part"]).withColumn("rank", F.col("start") + F.col("within")).drop("part", "start", "within"), totals


def superstep(rows: DataFrame, totals: dict[tuple[bool, int], int], capacity: int) -> DataFrame:
    """One sweep over documents and gaps, sorted by size: what became of each of rows (kind, id, size, rank), false being a document.

    The sizes in order are read as brackets, a document opening one and a gap closing the last one still open: so each
    gap gets its largest successor below it that no smaller gap has taken. A row's depth follows from its rank and the
    number of rows of each size; those of one depth, one pair for each size at most, meet in a window: gaps have got (id,
    got_size), documents that a gap has taken are marked.

    Documents larger than any gap open as many sequences as their tokens fill, the largest first, one each (seq, start). If all of
    them are small, DEALT of which fill a sequence, they are dealt to these sequences by rank, and those that
    overfill one wait.
    """
    largest = max((size for kind, size in totals if kind), default=0)
    above = {size: n for (kind, size), n in totals.items() if not kind and size > largest}
    new = left = -(-sum(size * n for size, n in above.items()) // capacity)
    dealt = bool(above) and max(above) * DEALT <= capacity
    depth, before, known = 0, 0, []
    opens = {}
    for size in sorted(above, reverse=True):
        opens[size] = (before, above[size] if dealt else min(left, above[size]))
        before, left = before + above[size], left - min(left, above[size])
    for size in range(1, capacity + 1):
        docs, gaps = totals.get((False, size), 0), totals.get((True, size), 0)
        if docs:
            known.append((False, size, depth, *opens.get(size, (0, 0))))
        if gaps:
            known.append((True, size, depth + docs, 0, 0))
        depth = max(0, depth + docs - gaps)
    known = F.broadcast(rows.sparkSession.createDataFrame(known, "kind boolean, size long, depth long, before long, opens long"))  # 2 * capacity rows at most
    level = F.when(F.col("kind"), F.col("depth") - F.col("rank")).otherwise(F.col("depth") + F.col("rank") + 1)
    opening = ~F.col("kind") & (F.col("rank") < F.col("opens"))
    rows = rows.join(known, ["kind", "size"]).select("kind", "id", "size", level.alias("level"), F.when(opening, F.col("before") + F.col("rank")).alias("turn"))
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    if dealt:
        along = Window.partitionBy(F.col("turn") % new).orderBy("turn")
        filled = F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        opened = rows.where("turn IS NOT NULL").select("kind", "id", "size", F.first("id").over(along).alias("seq"), (filled - F.col("size")).alias("start"))
        fits = F.col("start") + F.col("size") <= capacity
        opened = opened.select("kind", "id", "size", *none("got", "got_size"), F.lit(False).alias("taken"), *(F.when(fits, F.col(c)).alias(c) for c in ("seq", "start")))
    else:
        opened = rows.where("turn IS NOT NULL").select("kind", "id", "size", *none("got", "got_size"), F.lit(False).alias("taken"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("start"))
    idle = rows.where("turn IS NULL AND level <= 0").select("kind", "id", "size", *none("got", "got_size"), F.lit(False).alias("taken"), *none("seq", "start"))
    along = Window.partitionBy("level").orderBy("size", "kind")
    met = rows.where("turn IS NULL AND level > 0")
    pair = [F.when(F.col("kind"), F.lag(c).over(along)).alias(n) for c, n in (("id", "got"), ("size", "got_size"))]
    met = met.select("kind", "id", "size", *pair, (~F.col("kind") & F.lead("id").over(along).isNotNull()).alias("taken"), *none("seq", "start"))
    return checkpointed(opened.unionByName(idle).unionByName(met))


def packed(parts: DataFrame, capacity: int = 2048, rows_per_group: int = 100_000) -> DataFrame:
    """parts (with length) and the sequence_id and offset of each, at most capacity to a sequence and no holes in it.

    Supersteps follow each other until every document has its place: all documents and gaps are sorted by size and swept for
    successors at once, each gap gets one document at most, and the gaps are updated. Only the number of rows of each size, so
    2 * capacity numbers at most, reaches the driver. Tiny documents go in bundles first.

    Lengths of 1 to capacity are taken; null or other lengths have no place and fail. An empty table gives no rows.
    Repeated rows each have a place. Columns of parts are kept, but for earlier ones named sequence_id and offset, which are replaced.
    """
    names = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    rows = checkpointed(parts.select(F.struct(*names).alias("row"), F.col("length").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")))
    seen = rows.agg(F.count("*").alias("n"), F.count_if((F.col("size") > 0) & (F.col("size") <= capacity)).alias("fit")).first()
    if seen.n > seen.fit:
        raise ValueError(f"lengths of 1 to {capacity} can be packed")
    groups = max(16, seen.n // rows_per_group)
    numbered, totals = ranked(rows.select(F.lit(False).alias("kind"), "id", "size"), groups)
    items, members = bundled(numbered.select("id", "size", "rank"), {size: n for (_, size), n in totals.items()}, capacity)
    state = items.select(F.lit(False).alias("kind"), "id", "size")
    placed = []
    while True:
        numbered, totals = ranked(state, groups)
        if all(kind for kind, _ in totals):
            break
        step = superstep(numbered, totals, capacity)
        opened = step.where("seq IS NOT NULL")
        placed.append(step.where("got IS NOT NULL").select(F.col("got").alias("item"), F.col("id").alias("sequence_id"), (capacity - F.col("size")).alias("start")))
        placed.append(opened.select(F.col("id").alias("item"), F.col("seq").alias("sequence_id"), "start"))
        waiting = step.where("NOT kind AND seq IS NULL AND NOT taken").select("kind", "id", "size")
        gaps = step.where("kind").select("kind", "id", (F.col("size") - F.coalesce("got_size", F.lit(0))).alias("size"))
        fresh = opened.groupBy(F.col("seq").alias("id")).agg((capacity - F.sum("size")).alias("size")).select(F.lit(True).alias("kind"), "id", "size")
        state = waiting.unionByName(gaps).unionByName(fresh).where("size > 0")
    if not placed:
        return rows.select("row.*", F.col("id").alias("sequence_id"), F.col("id").alias("offset")).limit(0)
    place = members.join(reduce(DataFrame.unionByName, placed), "item").select("id", "sequence_id", (F.col("start") + F.col("at")).alias("offset"))
    return rows.join(place, "id").select("row.*", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents")))
