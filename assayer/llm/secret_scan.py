"""Secret scans with an incremental ledger: texts are addressed by content, and only unseen pairs of a blob and a rule version are scanned."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, removed, shared_folder, small, table, text_of


@dataclass(frozen=True)
class Rule:
    """pattern finds leftmost matches that don't overlap; a match counts if its group has at least `least` letters.

    hints are literals of which a text with a match holds one, whatever the case; without them every text is searched.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules. Runs under the least length can't match, so their patterns hold it where that is the same.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, any_case=True, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What is added to them: headers of private keys, tokens of a forge, signed web tokens.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("private key-----",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, scanned array<string>, spans {SPANS}"
#: Bytes of findings that may be broadcast.
BROADCAST_BYTES = 64 << 20


def spans(rules: tuple[Rule, ...]):
    """A column of (text, names of rules) -> what these rules find, by start and then in the order of rules; places are code points, the end is exclusive."""
    ordered = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for r in rules]

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            out = []
            for text, names in zip(texts, wanted, strict=True):
                found, lower = [], text.lower()
                for rank, (rule, pattern) in enumerate(ordered):
                    if rule.name in names and (not rule.hints or any(h in lower for h in rule.hints)):
                        found += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
                out.append([{"kind": ordered[rank][0].kind, "start": start, "end": end} for start, rank, end in sorted(found)])
            yield pd.Series(out)

    return find


def scan(versions: DataFrame, rules: tuple[Rule, ...], ledger: str, id_col: str = "path", text_col: str = "text") -> int:
    """Scans what the ledger, a folder of Parquet, doesn't hold yet and appends it; gives the number of blobs scanned.

    A blob is a text's SHA-256. A row of the ledger names a blob, the rule versions that it was scanned with, and what they
    found, so a pair that found nothing is known too. Each blob that occurs again, or that the ledger knows, is
    scanned in the row with its least id only. Those blobs are broadcast while a count shows that they are few, and then no text is
    shuffled; beyond that texts are joined by blob.

    Null texts count as empty. Repeated rows are one blob. An empty table adds nothing. Other columns are ignored.
    """
    spark = versions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else spark.createDataFrame([], LEDGER)
    names = F.array(*(F.lit(r.name) for r in rules))
    rows = versions.select(F.col(id_col).cast("string").alias("id"), F.sha2(text_of(text_col), 256).alias("blob"), text_of(text_col).alias("text"))
    seen = known.select("blob", F.explode("scanned").alias("name")).groupBy("blob").agg(F.collect_set("name").alias("seen"))
    blobs = rows.groupBy("blob").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    special = small(blobs.join(seen, "blob", "left").where("rows > 1 OR seen IS NOT NULL").select("blob", "first", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"), F.lit(True).alias("special")))
    todo = F.when(F.col("special"), F.array_except(names, "seen")).otherwise(names)
    due = rows.join(special, "blob", "left").where(F.col("special").isNull() | F.col("first").eqNullSafe(F.col("id"))).withColumn("todo", todo).where(F.size("todo") > 0)
    scanned = due.select("blob", F.col("todo").alias("scanned"), spans(rules)("text", "todo").alias("spans"))
    # rows with equal ids and texts are scanned each
    new = checkpointed(scanned.dropDuplicates(["blob"]))
    new.write.mode("append").parquet(ledger)
    return new.count()


def findings(versions: DataFrame, rules: tuple[Rule, ...], ledger: str, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id_col, blob, spans) for every row of versions: the ledger's findings by these rule versions, joined back to all paths.

    Only blobs with findings are joined, one row each: broadcast while their bytes are few, else shuffled, where a blob of
    very many rows is split by adaptive execution. Rows without findings have an empty array.
    """
    spark = versions.sparkSession
    names = F.array(*(F.lit(r.name) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    known = spark.read.schema(LEDGER).parquet(ledger)
    # a later version of a rule stands in a row of its own, which may hold its kind again
    entry = known.where(F.arrays_overlap("scanned", names) & (F.size("spans") > 0)).select("blob", F.explode("scanned").alias("name"), "spans").where(F.array_contains(names, F.col("name")))
    kind = F.substring_index("name", "@", 1)
    own = entry.select("blob", F.filter("spans", lambda s: s["kind"] == kind).alias("own"))
    order = F.transform(F.flatten(F.collect_list("own")), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    merged = own.groupBy("blob").agg(F.array_sort(order).alias("sorted"))
    found = checkpointed(merged.where(F.size("sorted") > 0).select("blob", F.transform("sorted", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")))
    weight = found.agg(F.sum(F.size("spans") * 32 + 128)).first()[0] or 0
    rows = versions.select(id_col, F.sha2(text_of(text_col), 256).alias("blob"))
    return rows.join(F.broadcast(found) if weight <= BROADCAST_BYTES else found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a version of a path of its own; the ledger is new and goes when its findings are joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    scan(docs, BASE + ADDED, ledger, id_col="doc_id")
    out = findings(docs, BASE + ADDED, ledger, id_col="doc_id")
    removed(spark, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _found(rank: int, rule: Rule) -> str:
    """What a rule finds, as SQL: texts taken apart at the matches give their places."""
    pattern = re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", rule.pattern.split(")")[0]) + rule.pattern[rule.pattern.index(")") :] if rule.any_case else rule.pattern
    pattern = pattern.replace("\\x20", " ").replace("'", "''")
    return f"""SELECT blob, '{rule.kind}' AS kind, {rank} AS rank, f[i] AS found,
  CAST(list_sum(list_transform(a[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT blob, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS a FROM b WHERE regexp_matches(t, '{pattern}')))
  WHERE length(regexp_extract(f[i], '{pattern}', {rule.group})) >= {rule.least}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob FROM documents), b AS (SELECT DISTINCT blob, t FROM d),
f AS ({" UNION ALL ".join(_found(n, r) for n, r in enumerate(BASE + ADDED))}),
g AS (SELECT blob, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(concat_ws(':', kind, s, s + length(found)), ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
  string_agg(concat_ws(':', kind, s, s + length(found)), ',' ORDER BY s, rank) AS spans FROM f GROUP BY blob)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (blob)
"""
