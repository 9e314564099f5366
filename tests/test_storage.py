"""Tables of the shared folder."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from ledgerloom import storage


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))
    assert storage.shared_dir(session("local[4]")).startswith("file:///")


def test_tables_go_with_their_scope(spark):
    df = spark.range(3)
    with storage.scope(spark):
        first = storage.settle(df, "first")
        with storage.scope(spark):
            second = storage.settle(first, "second")
            assert second.count() == 3
            inner = [Path(p.removeprefix("file:")) for p in storage._open()[-1]]
            assert all(p.exists() for p in inner)
        assert not any(p.exists() for p in inner) and first.count() == 3
        outer = [Path(p.removeprefix("file:")) for p in storage._open()[-1]]
    assert not any(p.exists() for p in outer)
    kept = storage.settle(df, "kept")
    assert kept.count() == 3


def test_spread(spark):
    assert storage.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert storage.spread(spark.range(100, numPartitions=3)).rdd.getNumPartitions() == 3
