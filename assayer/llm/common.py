"""What the corpus operators share: reading, checkpoints and bounds for broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpointed, shared_folder

__all__ = ["BROADCAST_ROWS", "bound", "checkpointed", "digest", "removed", "shared_folder", "small", "table", "text_of"]

#: Rows of two or three numbers that may be broadcast: some 60 MB as a hash table.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, checkpointed, with a broadcast hint if a count shows at most so many rows; else for a shuffled join."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """128 bits of SHA-256: texts of one digest count as equal."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once: within a lambda an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
