"""Documents as files: a Python data source whose writer shows all documents of a write or none."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from itertools import islice
from typing import TYPE_CHECKING

from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

if TYPE_CHECKING:
    import pandas as pd


@dataclass
class Written(WriterCommitMessage):
    """The attempt of a task that wrote documents; their names stay in a file of it, so that the driver gets none of them."""

    attempt: str | None


#: In a hidden folder: the attempts that count; in an attempt: the names of its documents.
COUNTED, NAMES = "counted", "names"


def plain(folder: str) -> str:
    return re.sub(r"^file:/*", "/", folder).rstrip("/")


class DocumentWriter(DataSourceWriter):
    """Each task writes its documents below a hidden folder (option `staging`) as those of its own attempt; the commit tells the attempts that count.

    An abort deletes that folder; a task that is stopped only later may leave a file there, which no reader sees.
    """

    def __init__(self, staging: str):
        self.staging = staging

    def write(self, rows: Iterator) -> Written:
        attempt = str(TaskContext.get().taskAttemptId())
        own, n = f"{self.staging}/{attempt}", 0
        for row in rows:
            parts = row["path"].split("/")
            if row["path"].startswith("/") or any(p in ("", ".", "..") or p.startswith(".writing-") for p in parts):
                raise ValueError(f"{row['path']!r} is no place below the folder")
            if not n:
                os.makedirs(own)
                names = open(f"{own}/{NAMES}", "w", encoding="utf-8")
            with open(f"{own}/{n}", "w", encoding="utf-8", newline="") as file:
                file.write(row["text"] or "")
                file.flush()
                os.fsync(file.fileno())
            names.write(json.dumps({"at": f"{self.staging}/{COUNTED}/{attempt}/{n}", "path": row["path"]}) + "\n")
            n += 1
        if n:
            names.flush()
            os.fsync(names.fileno())
            names.close()
        return Written(attempt if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.attempt is not None:
                os.makedirs(f"{self.staging}/{COUNTED}", exist_ok=True)
                os.replace(f"{self.staging}/{m.attempt}", f"{self.staging}/{COUNTED}/{m.attempt}")

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["staging"])


#: Documents that a task hands over to Python at a time; by default it would be ten thousand, as a whole.
AT_A_TIME = 16


class Refused(Exception):
    """Documents aren't written while there are errors."""


def write_documents(documents: DataFrame, folder: str, errors: DataFrame | None = None) -> None:
    """Writes documents (path, text) as files below a folder that all executors see.

    A document that is there already is replaced as a whole; readers see the old or the new one. Where a task fails none is
    touched. Where errors has a row nothing is written and Refused names the first ones. Two documents of one path are an error, as is a
    path that leads out of the folder. A null text is an empty file; an empty table writes nothing.
    """
    if errors is not None and (first := errors.limit(5).collect()):
        raise Refused("; ".join(", ".join(str(v) for v in r) for r in first))
    spark = documents.sparkSession
    spark.dataSource.register(Documents)
    folder = plain(folder)
    staging = f"{folder}/.writing-{uuid.uuid4().hex}"
    rows, batch = documents.select("path", "text"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, AT_A_TIME)
    try:
        rows.write.format("documents").mode("append").option("path", folder).option("staging", staging).save()
    finally:
        spark.conf.set(batch, before)
    try:
        if os.path.isdir(f"{staging}/{COUNTED}"):
            move_documents(spark, staging, folder)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def move_documents(spark: SparkSession, staging: str, folder: str) -> None:
    """Moves what counts in staging into place, in tasks, since a driver would have to hold all names and move one file after the other."""
    names = spark.read.schema("at string, path string").json(f"file:{staging}/{COUNTED}/*/{NAMES}")
    if twice := names.groupBy("path").count().where("count > 1").limit(1).collect():
        raise PySparkException(f"two documents of one name: {twice[0].path}")

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # a process that only writes or commits does without

        made = set()
        for batch in batches:
            for at, path in zip(batch["at"], batch["path"], strict=True):
                to = f"{folder}/{path}"
                if (parent := os.path.dirname(to)) not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                try:
                    os.replace(at, to)
                except FileNotFoundError:
                    if not os.path.exists(to):  # else another attempt of this task has moved it
                        raise
            yield pd.DataFrame({"n": [len(batch)]})

    names.mapInPandas(moved, "n long").groupBy().sum("n").collect()


#: Names that a task lists at a time.
LISTED = 1000


def remove_documents(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of documents, in tasks; what is directly in it is listed by one of them and dealt to all."""
    folder = plain(folder)

    def listed(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        if os.path.isdir(folder):
            with os.scandir(folder) as found:
                while names := [e.name for e in islice(found, LISTED)]:
                    yield pd.DataFrame({"name": names})

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            for name in batch["name"]:
                at = f"{folder}/{name}"
                if os.path.isdir(at) and not os.path.islink(at):
                    shutil.rmtree(at, ignore_errors=True)
                else:
                    with suppress(FileNotFoundError):
                        os.remove(at)
            yield pd.DataFrame({"n": [len(batch)]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1).coalesce(1).mapInPandas(listed, "name string").repartition(tasks).mapInPandas(removed, "n long").groupBy().sum("n").collect()
    shutil.rmtree(folder, ignore_errors=True)
