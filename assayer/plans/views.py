"""Views of the driver's tables as review data. The column texts are valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .code import CODE_VIEWS

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_findings": (
        "orders",
        [
            "o_orderkey AS id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity",
            "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'raw' ELSE 'rejected' END AS status",
            "CAST(o_custkey % 14 AS INT) AS category",
            "concat('src/f', CAST(o_custkey % 997 AS STRING), '.ts') AS file",
            "CAST(o_orderkey * 7 % 400 + 1 AS INT) AS start_line",
            "CAST(o_orderkey * 7 % 400 + 1 + o_custkey % 5 AS INT) AS end_line",
            "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS run",
            "CAST(o_orderkey % 6 AS INT) AS prerequisites",
        ],
    ),
    "v_candidates": (
        "lineitem",
        [
            "l_returnflag AS tool",
            "concat('src/p', CAST(l_partkey % 50 AS STRING), '.py') AS file",
            "l_linenumber AS line",
            "concat('r', CAST(l_suppkey % 10 AS STRING)) AS rule",
            "CASE WHEN l_quantity > 45 THEN 'CRITICAL' WHEN l_quantity > 30 THEN 'HIGH' WHEN l_quantity > 15 THEN 'MEDIUM' WHEN l_quantity > 5 THEN 'LOW' ELSE 'INFO' END AS severity",
            "l_orderkey * 10 + l_linenumber AS ord",
        ],
    ),
    "v_entries": (
        "part",
        [
            "p_partkey AS entry",
            "concat('src/f', CAST(p_partkey % 997 AS STRING), '.ts') AS file",
            "CAST(p_size * 8 AS INT) AS line",
            "CASE p_partkey % 5 WHEN 0 THEN 'webhook' WHEN 1 THEN 'page' WHEN 2 THEN 'server-action' WHEN 3 THEN 'http-route' ELSE 'job' END AS kind",
            "p_name AS name",
        ],
    ),
    "v_ledger": (
        "lineitem",
        [
            "CAST(l_suppkey % 11 AS INT) AS class",
            "concat('src/f', CAST(l_partkey % 400 AS STRING), '.ts') AS target",
            "CASE l_linestatus WHEN 'O' THEN 'checked' ELSE CASE l_returnflag WHEN 'R' THEN 'not_assessed' ELSE 'not_applicable' END END AS status",
            "concat('auditor', CAST(l_linenumber AS STRING)) AS auditor",
            "l_orderkey * 3 AS evidence",
        ],
    ),
    "v_key": (
        "part",
        [
            "p_partkey AS key_id",
            "concat('src/f', CAST(p_partkey % 997 AS STRING), '.ts') AS file",
            "CAST(p_size * 8 AS INT) AS lo",
            "CAST(p_size * 8 + p_partkey % 4 AS INT) AS hi",
            "CASE WHEN p_partkey % 3 = 0 THEN 'decoy' ELSE 'seeded' END AS kind",
        ],
    ),
    "v_usage": (
        "events",
        [
            "concat(CAST(user_id AS STRING), '/', CAST(month(ts) * 100 + day(ts) AS STRING), '/', event_type) AS response",
            "event_id AS ord",
            "CAST(round(value * 10) AS BIGINT) AS output",
            "CAST(event_id % 1000 AS BIGINT) AS input",
            "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 300 AS BIGINT) END AS cache_5m",
            "CAST(event_id % 77 AS BIGINT) AS cache_read",
        ],
    ),
    "v_hits": (
        "lineitem",
        [
            "CAST(l_orderkey % 499 AS INT) AS report",
            "l_orderkey * 10 + l_linenumber AS ord",
            "concat(CASE l_orderkey % 4 WHEN 0 THEN '/work/app/lib/p' WHEN 1 THEN './lib/p' WHEN 2 THEN '/src/lib/p' ELSE 'file:///work/app/lib/p' END, CAST(l_partkey % 50 AS STRING), '.py') AS path",
            "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS line",
            "concat('r', CAST(l_suppkey % 10 AS STRING)) AS rule",
            "CASE l_orderkey % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'warning' WHEN 2 THEN 'Note' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'low' WHEN 5 THEN NULL ELSE 'High' END AS level",
            "concat('uses `x`  of ', CAST(l_partkey AS STRING), '   twice ') AS message",
            "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS extra",
        ],
    ),
    "v_paths": (
        "part",
        [
            "p_partkey AS key",
            "concat(CASE p_partkey % 16 WHEN 0 THEN 'src/app/(group)/users/[id]/' WHEN 1 THEN 'apps/web/tests/' WHEN 2 THEN 'db/migrations/' WHEN 3 THEN 'app/@slot/api/users/' "
            "WHEN 4 THEN '' WHEN 5 THEN './app/Http/' WHEN 6 THEN 'pages/api/' WHEN 7 THEN 'src/pages/' WHEN 8 THEN 'supabase/migrations/' WHEN 9 THEN 'templates/mail/' "
            "WHEN 10 THEN 'a b/c/' WHEN 11 THEN '-x/y/' WHEN 12 THEN 'lib/../up/' WHEN 13 THEN '(app/lib/' WHEN 14 THEN 'lib/' ELSE 'lib/deep/er/' END, "
            "CASE p_partkey % 13 WHEN 0 THEN 'package-lock.json' WHEN 1 THEN 'seed.ts' WHEN 2 THEN 'conftest.py' WHEN 3 THEN 'go.sum' ELSE concat('f', CAST(p_size AS STRING), "
            "CASE p_partkey % 11 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.tsx' WHEN 2 THEN '.py' WHEN 3 THEN '_test.go' WHEN 4 THEN '.sql' WHEN 5 THEN '.html' WHEN 6 THEN '.mjs' WHEN 7 THEN '.module' WHEN 8 THEN '.kt' WHEN 9 THEN '.rules' ELSE '.md' END) END) AS path",
            "CASE p_partkey % 3 WHEN 0 THEN concat('\"Public\".\"', p_name, '\"') WHEN 1 THEN concat('PUBLIC.', p_brand) ELSE p_type END AS ident",
        ],
    ),
    "v_edges": ("lineitem", ["CAST(l_partkey % 1500 AS BIGINT) AS src", "CAST(l_suppkey * 31 % 1500 AS BIGINT) AS dst"]),
    **CODE_VIEWS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that may name the views."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names) + "\n" + sql
