"""The import graph of a source tree: what each file imports, resolved to files, and what a change reaches over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import java, re2
from ..plans.checkpoints import checkpointed
from ..plans.registry import Registry
from ..plans.views import view
from .coverage import closure
from .marks import Mark, bound, marks, marks_sql

REGISTRY = Registry()
# Forms of an import, and what may be left out of a file's name, in the order in which it is tried.
IMPORT = Mark("import", r"""(?:\bfrom\s*|\bimport\s*\(\s*|\bimport\s+|\brequire\s*\(\s*|\bexport\s*\*\s*from\s*)["'`]([^"'`]+)["'`]""", "", 1)
EXTENSIONS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
PATHS, BASE_URL = r'"paths"\s*:\s*\{([^}]*)\}', r'"baseUrl"\s*:\s*"([^"]*)"'
ALIAS = Mark("alias", r'"([^"]+?)\*?"\s*:\s*\[\s*"([^"]+?)\*?"', "[", 2)


def folded(path: Column) -> Column:
    """path without . and empty parts, and without each part that .. takes back; what leads above the root stays."""

    def step(parts: Column, part: Column) -> Column:
        up = (F.size(parts) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("")), parts), -1), F.lit("")) != "..")
        back = F.when(up, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.concat(parts, F.array(part)))
        return F.when(part.isin("", "."), parts).when(part == "..", back).otherwise(F.concat(parts, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def aliases(configs: DataFrame) -> DataFrame:
    """(path, n, prefix, target) of the path aliases of tsconfig.json and the like (path, text), in their order; targets are folded and below baseUrl."""
    blocks = configs.select("path", F.regexp_extract("text", java(PATHS), 1).alias("block"), F.regexp_extract("text", java(BASE_URL), 1).alias("base"))
    found = marks(blocks.select("path", "block"), [ALIAS], "path", "block").join(blocks.select("path", "base"), "path")
    target = F.concat_ws("/", "base", "g2")
    slash = F.when(F.col("g2").endswith("/"), "/").otherwise("")
    return found.select("path", "pos", F.col("g1").alias("prefix"), F.concat(folded(target), slash).alias("target")).withColumnRenamed("pos", "n")


def import_edges(files: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(src, dst): the files of files (path, text) that each of them imports.

    A relative import is folded below its file's folder, others have to begin with an alias (n, prefix, target), of which the first one by n counts;
    packages have none and go. Then the names that a file may have are tried in the order of EXTENSIONS, and for an
    import of .js the same without it. A file that imports itself is no edge. The aliases of a project are few and go along as one
    array; the names meet the files by equality. Null texts import nothing.
    """
    found = marks(files, [IMPORT]).select("path", F.col("g1").alias("spec")).distinct()
    if alias is not None:
        listed = alias.agg(F.array_sort(F.collect_list(F.struct("n", "prefix", "target"))).alias("aliases"))
        found = found.crossJoin(F.broadcast(listed))  # one row
    else:
        found = found.withColumn("aliases", F.array().cast("array<struct<n:bigint,prefix:string,target:string>>"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    first = F.get(F.filter("aliases", lambda a: F.col("spec").startswith(a["prefix"])), F.lit(0))
    aliased = bound(first, lambda a: F.concat(a["target"], F.lit("/"), F.substr("spec", F.length(a["prefix"]) + 1)))
    base = F.when(F.col("spec").startswith("."), folded(F.concat(folder, "spec"))).otherwise(folded(aliased))
    named = found.select("path", "spec", base.alias("base")).where("base IS NOT NULL")
    bare = F.regexp_replace("base", r"\.[cm]?js$", "")
    names = F.concat(F.transform(F.array(*map(F.lit, EXTENSIONS)), lambda e: F.concat("base", e)), F.transform(F.array(*map(F.lit, EXTENSIONS[1:])), lambda e: F.concat(bare, e)))
    tried = named.select("path", "spec", F.posexplode(names).alias("n", "dst"))
    hits = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst").groupBy("path", "spec").agg(F.min_by("dst", "n").alias("dst"))
    return hits.where("dst <> path").select(F.col("path").alias("src"), "dst").distinct()


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node) of the changed files (node) and all files that import them, directly or not."""
    return closure(edges, changed)


_CONFIG = '{ "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["./src/*"], "~/*": ["src/x/../deep/*"], "@/m1*": ["./none/*"] } } }'
_FOLD = "regexp_replace({0}, '(^|/)[^/.][^/]*/\\.\\.(/|$)', '\\1')"


def _folded_sql(path: str, times: int = 4) -> str:
    """Folded as far as the view needs it: parts that begin with a dot aren't taken back."""
    out = f"regexp_replace(regexp_replace({path}, '/(\\./)+', '/', 'g'), '^\\./', '')"
    for _ in range(times):
        out = _FOLD.format(out)
    return f"rtrim({out}, '/')"


_EDGES = f"""
, found AS (SELECT DISTINCT path, g1 AS spec FROM ({marks_sql("v_imports", [IMPORT])})),
based AS (SELECT path, spec, {_folded_sql("CASE WHEN starts_with(spec, '.') THEN concat(regexp_replace(path, '[^/]*$', ''), spec) WHEN starts_with(spec, '@/') THEN concat('src/', substring(spec, 3)) WHEN starts_with(spec, '~/') THEN concat('src/deep/', substring(spec, 3)) END")} AS base FROM found),
ext AS (SELECT e, row_number() OVER () AS n FROM (SELECT unnest({EXTENSIONS}) AS e)),
tried AS (SELECT path, spec, base || e AS dst, n FROM based, ext UNION ALL SELECT path, spec, regexp_replace(base, '{re2(r'\.[cm]?js$')}', '') || e, n + 100 FROM based, ext WHERE n > 1),
edges AS (SELECT DISTINCT path AS src, dst FROM (SELECT path, spec, arg_min(dst, n) AS dst FROM tried WHERE dst IN (SELECT path FROM v_imports) GROUP BY ALL) WHERE path <> dst)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame([("tsconfig.json", _CONFIG)], "path string, text string")
    return import_edges(view(spark, sf_dir, "v_imports"), aliases(config))


@REGISTRY.query(_EDGES + "SELECT * FROM edges", "v_imports")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents as modules import."""
    return _edges(spark, sf_dir)


@REGISTRY.query(_EDGES + ", r AS (SELECT path AS node FROM v_imports WHERE path IN ('src/d5/index.ts', 'src/m11.tsx') UNION SELECT e.src FROM edges e JOIN r ON e.dst = r.node) SELECT node FROM r", "v_imports")
def import_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules that a change of two of them reaches."""
    changed = view(spark, sf_dir, "v_imports").where("path IN ('src/d5/index.ts', 'src/m11.tsx')").select(F.col("path").alias("node"))
    return affected(checkpointed(_edges(spark, sf_dir)), changed)


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
