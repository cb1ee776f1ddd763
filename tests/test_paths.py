from assayer.operators.paths import lockfile_roots


def test_the_nearest_folder_with_a_lock_file(spark):
    files = spark.createDataFrame([("apps/web/go.sum",), ("package-lock.json",), ("apps/web/src/x.ts",), ("lib/yarn.lock.txt",), (None,)], "path string")
    folders = spark.createDataFrame([("apps/web/src",), ("apps/web",), ("apps/webby",), ("",), ("lib",), ("lib",)], "dir string")
    assert sorted((r.dir, r.root) for r in lockfile_roots(folders, files).collect()) == [("", ""), ("apps/web", "apps/web"), ("apps/web/src", "apps/web"), ("apps/webby", ""), ("lib", "")]
    none = lockfile_roots(folders, files.where("path LIKE 'apps%'"))
    assert {r.dir: r.root for r in none.collect()}["lib"] is None and lockfile_roots(folders.limit(0), files).count() == 0
