import posixpath
import random

from assayer.operators.imports import aliases, folded, import_edges
from pyspark.sql import functions as F


def test_folded_paths(spark):
    rng = random.Random(9)
    paths = ["", ".", "..", "a/..", "a/../..", "../../a", "a//b/./c", "..a/b", "./../x", *("/".join(rng.choices(["a", "b", ".", "..", "", "..c"], k=rng.randrange(1, 9))) for _ in range(300))]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", folded(F.col("p")).alias("f")).collect()
    for r in got:
        want = posixpath.normpath(r.p.strip("/") or ".")
        assert r.f == ("" if want == "." else want), r.p


FILES = {
    "src/a.ts": "import x from './b'\nimport y from \"../lib/c.js\"\nconst z = require('react')\nexport * from '@/util'\nimport './a'",
    "src/b/index.tsx": "import('~lib/c'); import x from './../none'; import t from '../a.js'",
    "lib/c.js": "",
    "lib/c.ts": "import d from './c.js'",
    "src/util.mts": None,
    "top.ts": "import '../../src/a'\nimport e from './src/b/'",
}
CONFIG = '{"compilerOptions": {"baseUrl": "./", "paths": {\n "@/*": ["./src/*"], "~lib/*": ["src/../lib/*", "other/*"], "@/util*": ["none/*"]}}}'


def test_edges_of_files(spark):
    files = spark.createDataFrame([(p, t, "clash") for p, t in FILES.items()], "path string, text string, aliases string")
    found = aliases(spark.createDataFrame([("tsconfig.json", CONFIG), ("jsconfig.json", "{}"), ("x", None)], "path string, text string"))
    assert [(r.prefix, r.target) for r in found.orderBy("n").collect()] == [("@/", "src/"), ("~lib/", "lib/"), ("@/util", "none/")]
    got = {(r.src, r.dst) for r in import_edges(files, found).collect()}
    assert got == {("src/a.ts", "src/b/index.tsx"), ("src/a.ts", "lib/c.js"), ("src/a.ts", "src/util.mts"), ("src/b/index.tsx", "lib/c.ts"), ("src/b/index.tsx", "src/a.ts"), ("lib/c.ts", "lib/c.js"), ("top.ts", "src/b/index.tsx")}
    plain = {(r.src, r.dst) for r in import_edges(files).collect()}
    assert plain == got - {("src/a.ts", "src/util.mts"), ("src/b/index.tsx", "lib/c.ts")}
    assert import_edges(files.limit(0), found).count() == 0
