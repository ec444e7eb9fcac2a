"""Staged tables and the folder that executors share."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from bitlab.llm.common import new_folder, shared_root, spare_prefix, stage, staged_run


def test_a_run_removes_its_own_tables_only(spark):
    before = stage(spark.range(3), "before")
    with staged_run() as remove:
        mine, kept = stage(spark.range(4), "mine"), stage(spark.range(5), "kept")
        with staged_run() as inner:
            theirs = stage(spark.range(6), "theirs")
            assert inner is not remove
        paths = [Path(x.inputFiles()[0].removeprefix("file://")).parent for x in (mine, kept)]
        remove(spark, keep="kept")
        assert not paths[0].exists() and kept.count() == 5
        remove(spark)
        assert not paths[1].exists()
    assert before.count() == 3 and theirs.count() == 6
    assert Path(new_folder(spark, "x").removeprefix("file://")).parent.exists()


@pytest.mark.parametrize("warehouse", ["file:/home/me/spark-warehouse", "/home/me/spark-warehouse"])
def test_no_machine_local_folder_on_clusters(warehouse):
    conf = {"spark.master": "spark://host:7077", "spark.sql.warehouse.dir": warehouse}
    session = lambda **more: SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: (conf | more).get(k, *d)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert shared_root(session(**{"spark.sql.warehouse.dir": "hdfs://n/w/"})) == "hdfs://n/w"
    assert shared_root(session(**{"spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    assert shared_root(session(**{"spark.master": "local[2]"})).startswith("file://")


def test_spare_prefix(spark):
    df = spark.createDataFrame([(1, 2)], "__MIX_slot int, ___mix_a int")
    assert spare_prefix(df, "__mix_") == "____mix_" and spare_prefix(df, "x") == "x"
