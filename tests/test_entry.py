"""The entry module without what it may lack, and the shared folder."""

import sys

import pytest

from quayside import shared


@pytest.mark.parametrize("name", ["xxhash", "quayside.llm.queries", "corpus_pipeline"])
def test_entry_without(monkeypatch, name):
    import __spark_entry__ as entry

    for known in [m for m in sys.modules if m.startswith("quayside.llm") or m in ("corpus_pipeline", "xxhash")]:
        monkeypatch.delitem(sys.modules, known)
    monkeypatch.setitem(sys.modules, name, None)
    assert "gc_candidates" in entry.queries() and "pipeline" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, conf):
        self.sparkContext, self._conf = _Context(master), conf
        self.conf = self

    def get(self, key, default):
        return self._conf.get(key, default)


def test_shared_folder():
    assert shared.folder(_Session("spark://m:7077", {"spark.checkpoint.dir": "hdfs://x/shared/"})) == "hdfs://x/shared"
    assert "quayside-" in shared.folder(_Session("local[4]", {}))
    for master in ("spark://m:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.folder(_Session(master, {}))
