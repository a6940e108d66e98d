"""The folder of scratch tables."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
import pytest

from millrace.llm.common import shared_dir, tidy


class Session:
    """The settings of a session; as in Spark, the folder cannot be set once it runs."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        raise AssertionError(key)


def test_given_folder_comes_first():
    assert shared_dir(Session(spark_checkpoint_dir="hdfs:///c", spark_master="spark://h:7077")) == "hdfs:///c"


def test_local_session_without_a_folder_gets_one_for_good():
    one, other = (Session(spark_master="local[2]", spark_app_id=i) for i in ("folder-a", "folder-b"))
    assert shared_dir(one).startswith("file://") and shared_dir(one) == shared_dir(one) != shared_dir(other)


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[2,1,1024]"])
def test_cluster_without_a_folder_raises(master):
    with pytest.raises(RuntimeError):
        shared_dir(Session(spark_master=master))


def test_a_waiting_worker_holds_no_freed_memory():
    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    @tidy
    def run(batches):
        for batch in batches:
            kept.append([bytes(2000) for _ in range(60_000)])  # 120 MB in small pieces
            kept.append(bytes(2000))  # above them, so the heap's end stays where it is
            del kept[0]
            yield batch

    kept: list = []
    batch = pa.RecordBatch.from_pydict({"a": ["x"]})
    before = held()
    task = run(iter([batch]))
    assert next(task) is batch and held() - before > 80
    assert list(task) == [] and held() - before < 40
