"""Exact deduplication by two passes over a Bloom filter."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, small, table, text_of


def normalised(column: str) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text_of(column), string.ascii_uppercase, string.ascii_lowercase)


#: Copies from which a group counts as large; there is one large group for so many rows at most.
LARGE = 10_000


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 64, bits_per_repeat: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Pass one sets a bit for each document in a wide filter of bits_per_row bits a row, which is never built as a whole: the
    numbers of the bits are counted, merged where the rows are first, and those set more than once remain. They make a
    second, dense filter with bits_per_repeat bits each, in blocks of 256. Pass two looks both bits of each document up in
    its block: where one is missing, the text occurs once and the row goes straight through. Only the others are
    shuffled and grouped by SHA-256. Neither filter has false negatives, so no repeated text is missed; false positives
    cost a shuffled row. The blocks are broadcast while a count shows that they are few (some eight million repeated texts);
    beyond that the rows' hashes are shuffled to them.

    The rows that stay are found by an aggregate that merges before it shuffles. Large groups are few, so their
    outcome is broadcast to their rows wherever they are, and no group has to fit a task.

    Null texts count as empty and so form a group with empty ones. Of a group the largest doc_id stays, a null
    doc_id ranking lowest; of rows with equal text and doc_id one stays. Texts are hashed whole. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    slots = 1 << max(10, (rows.count() * bits_per_row - 1).bit_length())
    slot = F.pmod(F.xxhash64("text_sha256"), F.lit(slots))
    repeated = checkpointed(rows.groupBy(slot.alias("slot")).count().where("count > 1").select("slot"))
    blocks = max(1, repeated.count() * bits_per_repeat // 256)
    place = lambda of: F.pmod(F.xxhash64(of, F.lit(1)), F.lit(blocks))
    two = lambda of: [F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(256)).cast("int") for seed in (2, 3)]
    mask = lambda bit, n: F.when(F.shiftright(bit, 6) == n, F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))
    words = [F.bit_or(mask(two("slot")[0], n).bitwiseOR(mask(two("slot")[1], n))).alias(f"w{n}") for n in range(4)]
    filtered = small(repeated.groupBy(place("slot").alias("block")).agg(*words))
    probed = rows.withColumn("slot", slot).withColumn("block", place("slot")).join(filtered, "block", "left")
    maybe = F.lit(True)
    for bit in two("slot"):
        word = F.get(F.array(*(F.coalesce(F.col(f"w{n}"), F.lit(0).cast("long")) for n in range(4))), F.shiftright(bit, 6))
        maybe = maybe & (F.bit_get(word, bit.bitwiseAND(F.lit(63))) == 1)
    probed = checkpointed(probed.select("doc_id", "text_sha256", "row", maybe.alias("maybe")))
    again = probed.where("maybe").drop("maybe")
    groups = checkpointed(again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")))
    large = small(groups.where(F.col("group_size") >= LARGE))
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        grouped = again.join(F.broadcast(groups), "text_sha256")
    else:
        usual = again.join(large.select("text_sha256"), "text_sha256", "left_anti").join(groups.where(F.col("group_size") < LARGE), "text_sha256")
        grouped = usual.unionByName(again.join(large, "text_sha256"))
    grouped = grouped.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
    single = probed.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(grouped)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
