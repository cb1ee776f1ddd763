"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, checkpointed, digest, small, table, text_of

WORDS, SHARE = 5, 0.8


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words; none where there are fewer words."""

    def each(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<long>"))

    return bound(words, each)


def shingles(words: Column, n: int) -> Column:
    def each(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return bound(words, each)


def leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Links (doc_id, text_key, item_id, matched, total, containment) of documents that hold share or more of an item's shingles of n words.

    Items are parted by size into powers of two. An item's sketch holds its least hashes, which are a MinHash sample that all
    items and documents draw alike. Its length follows from the class: more than (1 - share) of the largest size,
    so a document that holds share of the item holds one of the sketch at least, however long it is, and no leak is lost. Windows of a document
    need no sketch of their own: all its hashes meet the sketches in a join. Only pairs that meet are verified, with the shingles
    themselves. Equal texts of a document are verified once.

    An item of fewer than n words has one shingle, all its words, and is found where they follow each other. Null and empty
    items and documents without words leak nothing. Repeated items with one id count as one for each of their texts.
    Empty tables give no rows. Other columns are ignored.
    """
    item = items.select(F.col(item_id).alias("item_id"), words_of(text_of(item_text)).alias("w")).where(F.size("w") > 0).distinct()
    item = checkpointed(item.withColumn("width", F.least(F.size("w"), F.lit(n))).withColumn("item", F.monotonically_increasing_id()))
    widths = sorted(r.width for r in item.select("width").distinct().collect())  # n at most

    def of_width(made: Callable[[Column, int], Column], kind: str) -> Column:
        return F.coalesce(*(F.when(F.col("width") == k, made(F.col("w"), k)) for k in widths), F.array().cast(kind))

    item = item.select("item", "item_id", of_width(shingles, "array<string>").alias("parts"), F.array_sort(F.array_distinct(of_width(hashes, "array<long>"))).alias("h"))
    item = checkpointed(item.withColumn("total", F.size("parts")))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("total").cast("double"))))
    length = F.floor(largest * (1 - share) + 1e-9).cast("int") + 1
    sketch = item.select("item", F.explode(F.slice("h", F.lit(1), length)).alias("h"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", digest(F.col("text")))
    every = lambda made, kind: bound(words_of(F.col("text")), lambda w: F.concat(F.array().cast(kind), *(made(w, k) for k in widths)))
    probes = keyed.select("text_key", F.explode(every(hashes, "array<long>")).alias("h"))
    met = checkpointed(probes.join(small(sketch), "h").select("text_key", "item").distinct())
    texts = keyed.join(small(met.select("text_key").distinct()), "text_key", "left_semi")
    own = texts.select("text_key", F.explode(every(shingles, "array<string>")).alias("part")).join(small(met), "text_key")
    wanted = item.select("item", F.explode("parts").alias("part"))
    matched = own.join(small(wanted), ["item", "part"]).groupBy("text_key", "item").agg(F.count_distinct("part").alias("matched"))
    found = matched.join(small(item.select("item", "item_id", "total")), "item")
    found = found.withColumn("containment", F.col("matched") / F.col("total")).where(F.col("containment") >= share).drop("item")
    return keyed.select("doc_id", "text_key").join(small(found), "text_key").select("doc_id", "text_key", "item_id", "matched", F.col("total").cast("long").alias("total"), "containment")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "total", F.round("containment", 6).alias("containment"))


def _parts_sql(key: str, source: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS part FROM (SELECT {key}, {words} AS w FROM {source}) x WHERE len(w) >= {WORDS}"


def _joined_sql(key: str, source: str) -> str:
    """All words with a space before and behind each, so that an item of few words can be looked for as it stands."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"SELECT {key}, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM (SELECT {key}, {words} AS w FROM {source}) x"


ORACLE = f"""
WITH d AS ({_parts_sql("doc_id", "documents")}), b AS ({_parts_sql("item_id", "benchmark")}), n AS (SELECT item_id, count(*) AS total FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, count(*) AS matched, any_value(total) AS total, round(CAST(count(*) AS DOUBLE) / any_value(total), 6) AS containment
FROM d JOIN b ON d.part = b.part JOIN n ON n.item_id = b.item_id GROUP BY doc_id, b.item_id HAVING CAST(count(*) AS DOUBLE) / any_value(total) >= {SHARE}
UNION ALL SELECT doc_id, item_id, 1 AS matched, 1 AS total, 1.0::DOUBLE AS containment FROM ({_joined_sql("doc_id", "documents")}) d
JOIN ({_joined_sql("item_id", "benchmark")}) b ON b.n BETWEEN 1 AND {WORDS - 1} AND contains(d.joined, b.joined)
"""
