"""Checkpoint folder: required on a cluster, scratch only on a local master."""

import pytest

from envspark.session import checkpoint_dir


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)
        self.values = {}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session(master))


def test_configured_folder_is_used():
    s = _Session("yarn")
    s.set("spark.checkpoint.dir", "hdfs:///ckpt")
    assert checkpoint_dir(s) == "hdfs:///ckpt"


def test_local_master_gets_a_scratch_folder(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    assert checkpoint_dir(_Session("local[4]")).startswith(str(tmp_path))
