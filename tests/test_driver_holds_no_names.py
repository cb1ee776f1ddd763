"""Documents of a write are known to the tasks only: the driver gets an attempt each, and neither moves nor deletes them one by one."""

import os
import pickle

import pytest
from pyspark.errors import PySparkException

from assayer.sources import documents
from assayer.sources.documents import DocumentWriter, Written, remove_documents, write_documents


class Context:
    def taskAttemptId(self) -> int:
        return 7


def test_what_a_task_tells_does_not_grow(tmp_path, monkeypatch):
    monkeypatch.setattr(documents.TaskContext, "get", lambda: Context())
    sizes = []
    for n in (1, 500):
        told = DocumentWriter(f"{tmp_path}/{n}/.writing-x").write({"path": f"d/{i}.txt", "text": "x"} for i in range(n))
        sizes.append(len(pickle.dumps(told)))
    assert sizes[0] == sizes[1] and isinstance(told, Written)
    assert DocumentWriter(f"{tmp_path}/0/.writing-x").write(iter(())) == Written(None) and not (tmp_path / "0").exists()


def test_the_driver_moves_and_deletes_none(spark, tmp_path, monkeypatch):
    folder, moved, real = str(tmp_path / "out"), [], os.replace
    monkeypatch.setattr(os, "replace", lambda a, b: moved.append(a) or real(a, b))
    names = ["a.txt", "b c/é\"\\\n.txt", "b c/d.txt", *(f"x{i}/y.txt" for i in range(30))]
    write_documents(spark.createDataFrame([(n, n) for n in names], "path string, text string").repartition(3), folder)
    held = {os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files}
    assert held == set(names) and not moved
    assert all(open(f"{folder}/{n}", newline="").read() == n for n in names)
    with pytest.raises(PySparkException, match="two documents of one name: same"):
        write_documents(spark.createDataFrame([("same", "1"), ("other", "2"), ("same", "3")], "path string, text string").repartition(3), folder)
    assert not os.path.exists(f"{folder}/other") and not [f for f in os.listdir(folder) if f.startswith(".writing-")]
    os.symlink(tmp_path, f"{folder}/link")
    (tmp_path / "kept").write_text("")
    remove_documents(spark, folder)
    assert not os.path.exists(folder) and (tmp_path / "kept").exists()
    remove_documents(spark, folder)
