"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, table, text_of

#: Fixed value: the multiplier of the published generator, key = key * STEP + 1 mod 2^64.
STEP = 2862933555777941757
LOW = (1 << 32) - 1


def _bits(column: Column, mask: int) -> Column:
    return column.bitwiseAND(F.lit(mask).cast("long"))


def _product(low: Column, factor: int) -> Column:
    """low * factor mod 2^32 of numbers under 2^32, where no step leaves 63 bits."""
    above = _bits(low * F.lit(factor >> 16).cast("long"), 0xFFFF) * F.lit(1 << 16).cast("long")
    return _bits(low * F.lit(factor & 0xFFFF).cast("long") + above, LOW)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state; the two halves are kept apart because ANSI arithmetic doesn't wrap."""
    a, b = (low * F.lit(part).cast("long") for part in (STEP & 0xFFFF, STEP >> 16 & 0xFFFF))
    middle = F.shiftright(a, 16) + b
    new_low = _bits(middle, 0xFFFF) * F.lit(1 << 16).cast("long") + _bits(a, 0xFFFF) + F.lit(1).cast("long")
    carry = F.shiftright(middle, 16) + F.shiftright(new_low, 32)
    return _bits(carry + _product(low, STEP >> 32) + _product(high, STEP & LOW), LOW), _bits(new_low, LOW)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a long key. Each jump leads to a higher shard, so as many jumps as shards are enough."""

    def jump(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        divisor = (F.shiftright(high, 1) + F.lit(1).cast("long")).cast("double")
        onward = F.floor((state["next"] + F.lit(1).cast("long")).cast("double") * (F.lit(float(1 << 31)) / divisor))
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("shard"), onward.cast("long").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        _bits(F.shiftrightunsigned(key, 32), LOW).alias("high"), _bits(key, LOW).alias("low"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda state: state["shard"].cast("int"))


def shards(docs: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_group: int = 100_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is key: shard depends on the document's key and the number of shards, and grown_shard, for one shard more,
    differs from it only where it is the new shard. Keys are hashed first, so that runs of keys spread. size is the
    bytes of the text plus 1. slot counts the rows of a shard from 0 without gaps; it is found from counts of groups
    of about rows_per_group rows (by a hash of the row's number), so that no task has to order a whole shard.

    Null and empty texts have size 1 and checksum 0. Rows with equal keys go to one shard, null keys too; each
    has a slot of its own. An empty table gives no rows. Other columns are ignored.
    """
    text = text_of(text_col)
    key = F.xxhash64(id_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), jump_hash(key, count).alias("shard"), jump_hash(key, count + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("row"),
    )
    rows = checkpointed(rows)
    groups = max(16, rows.count() // (count * rows_per_group))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    ranked = rows.withColumn("within", within).join(small(starts), ["shard", "part"])
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
