"""Numbers for all rows of a table in one order, without one window over all of them, and blocks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with name, their number from 1 in this order.

    Rows are dealt into ranges of the order and sorted there; the driver sees one count a range, from which each range knows where it begins.
    Rows that the order can't tell apart are numbered in some order. An empty table stays empty.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    starts, before = [], 0
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("rows"), F.min("_at").alias("first")).collect()):
        starts.append((r["_part"], before - r.first))
        before += r.rows
    begun = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _before long"))  # one row a range
    return dealt.join(begun, "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


#: Rows of a block: what one written document holds at most.
BLOCK_ROWS = 65_536


def in_blocks(rows: DataFrame, name: str = "_block", size: int = BLOCK_ROWS) -> DataFrame:
    """rows with name, the number of a block of at most size of them that were read one behind the other.

    A group within a block is bounded however long the table is, so that what is collected of it stays small.
    """
    return rows.withColumn(name, F.floor(F.monotonically_increasing_id() / size))
