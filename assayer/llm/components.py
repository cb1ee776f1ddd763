"""Connected components of a graph given as a table of links, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected(edges: DataFrame) -> DataFrame | None:
    """(node, component) for every node of the links (a, b), the component being its least node; None if there are none.

    Large stars and small stars by turns (Kiveris et al., 2014): every node's larger neighbours are hung on its least
    neighbour, then its smaller ones, until only stars are left, which takes about log^2 of the longest path turns. Minima are
    aggregated before they are shuffled and the joins have one row a node on one side, so a hub can be split.
    """
    a, b = edges.columns
    stars = checkpointed(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    sign = signature(stars)
    if not sign[0]:
        return None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        stars = checkpointed(hung.unionByName(least.withColumnRenamed("least", "b")).distinct())
        before, sign = sign, signature(stars)
        if sign == before:
            break
    centres = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*edges.columns)).alias("bits")).first()
    return row.rows, row.bits
