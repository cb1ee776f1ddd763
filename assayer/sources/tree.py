"""Source trees as tables: a Python data source that lists and reads the folders of a tree in parallel."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import LOCKFILES, NON_RUNTIME, POLICY

# Folders that aren't opened, what source is, and the size from which a file isn't read.
PRUNED = {
    "node_modules", ".git", ".next", "dist", "build", "out", "coverage", ".turbo", ".vercel", ".security-audit", "vendor", ".svelte-kit",
    ".output", ".cache", "storybook-static",
}
SOURCE = rf"\.(?:[cm]?[jt]sx?)$|\.routing\.yml$|\.(?:php|module|inc|theme|install)$|\.twig$|(^|/)config/(?:routes(?:/[^/]+)?|packages/security)\.ya?ml$|\.py$|(^|/)templates/.+\.html?$|\.go$|{POLICY}"
LARGEST = 1_000_000
SCHEMA = "path string, name string, size long, modified timestamp, lockfile boolean, text string"


@dataclass
class Folders(InputPartition):
    """Folders below the root (path, deep), each by itself or with all below it."""

    of: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    """The tree is listed by the driver level by level until there are folders enough; tasks list and read the rest.

    However many folders that are, they are dealt to as many tasks as the option `folders` says at most. Pruned folders and those that the
    option `under` rules out are never opened, and symbolic links aren't followed.
    """

    def __init__(self, options: dict):
        self.root = re.sub(r"^file:/*", "/", options["path"]).rstrip("/")
        self.under = options.get("under", "").strip("/")
        self.since = float(options["modifiedafter"]) if "modifiedafter" in options else None
        self.every = options.get("files", "source") == "all"
        self.enough = int(options.get("folders", "64"))
        self.largest = int(options.get("largest", LARGEST))

    def partitions(self) -> list[Folders]:
        done, level = [], [""]
        while level and len(done) + len(level) < self.enough:
            done += [(path, False) for path in level]
            level = [below for path in level for below in self.folders(path)]
        every = done + [(path, True) for path in level]
        return [Folders(every[n :: self.enough]) for n in range(min(len(every), self.enough))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        waiting = list(partition.of)
        while waiting:
            path, deep = waiting.pop()
            if deep:
                waiting += [(below, True) for below in self.folders(path)]
            for entry in self.entries(path):
                if row := self.row(f"{path}/{entry.name}".lstrip("/"), entry):
                    yield row

    def entries(self, path: str) -> list[os.DirEntry]:
        with os.scandir(f"{self.root}/{path}") as found:
            return sorted((e for e in found if not e.is_symlink()), key=lambda e: e.name)

    def folders(self, path: str) -> list[str]:
        below = [f"{path}/{e.name}".lstrip("/") for e in self.entries(path) if e.name not in PRUNED and e.is_dir(follow_symlinks=False)]
        return [p for p in below if not self.under or f"{self.under}/".startswith(f"{p}/") or p.startswith(f"{self.under}/")]

    def row(self, path: str, entry: os.DirEntry) -> tuple | None:
        if self.under and not path.startswith(f"{self.under}/") and path != self.under:
            return None
        lockfile = entry.name in LOCKFILES
        source = re.search(SOURCE, path) is not None
        if entry.name in PRUNED or not (self.every or lockfile or source):
            return None
        about = entry.stat(follow_symlinks=False)
        if not stat.S_ISREG(about.st_mode) or (self.since is not None and about.st_mtime <= self.since):
            return None
        read = source and about.st_size < self.largest and not self.every
        if not (read or lockfile or self.every):
            return None
        text = None
        if read:
            with open(f"{self.root}/{path}", encoding="utf-8", errors="replace", newline="") as file:
                text = file.read()
        return path, entry.name, about.st_size, datetime.fromtimestamp(about.st_mtime, UTC), lockfile, text


class TreeSource(DataSource):
    """spark.read.format("tree").load(root): path, name, size, modified, lockfile, text of the source files and lock files of a tree.

    Source files under LARGEST bytes have their text; lock files of any size are listed, without it unless they are source too. Options: files ("all" lists
    every file, without texts), under (a folder), modifiedAfter (seconds since 1970), folders (how many the driver lists at least
    before tasks take over, and how many tasks there are at most), largest. The root lies where all executors see it.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def inventory(files: DataFrame) -> DataFrame:
    """(what, n, paths): files of each language, runtime files of Python and Go, and go.mod (the least deep first), workflows, Dockerfiles and infrastructure by name.

    files (path, name) are all files of a tree. Languages and runtime files are counted only, so no list grows with them.
    """
    from pyspark.sql import functions as F

    from ..functions.scalars import LANGUAGES

    path, name = F.col("path"), F.col("name")
    counted = [F.when(name.rlike(p), F.lit(f"language {k}")) for k, p in LANGUAGES.items()]
    counted += [F.when(name.rlike(LANGUAGES[k]) & ~path.rlike(NON_RUNTIME), F.lit(f"runtime {k}")) for k in ("python", "go")]
    listed = [F.when(name == "go.mod", F.lit("go.mod")), F.when(path.rlike(r"^\.github/workflows/[^/]+\.ya?ml$"), F.lit("workflow")), F.when(name.rlike(DOCKERFILE), F.lit("dockerfile")),
              F.when(name.rlike(COMPOSE) | name.rlike(r"\.tf$") | (name == "Chart.yaml") | name.rlike(r"^kustomization\.ya?ml$"), F.lit("iac"))]
    entry = lambda what, held: F.when(what.isNotNull(), F.struct(what.alias("what"), F.lit(held).alias("held")))
    # one pass for both, since a tree is listed anew for each
    rows = files.select("path", F.explode(F.array_compact(F.array(*(entry(w, False) for w in counted), *(entry(w, True) for w in listed)))).alias("of")).select("path", "of.*")
    depth = F.when(F.col("what") == "go.mod", F.size(F.split("path", "/"))).otherwise(0)
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("held"), F.struct(depth.alias("depth"), "path")))), lambda x: x["path"])
    return rows.groupBy("what").agg(F.count("*").alias("n"), held.alias("paths"))


# Names of Dockerfiles and of files that describe services.
DOCKERFILE = r"^(?:Dockerfile|Containerfile)(?:\..+)?$|(?i)\.(?:dockerfile|containerfile)$"
COMPOSE = r"(?i)^(?:docker-)?compose(?:\.[\w-]+)?\.ya?ml$"
