"""The shared folder for intermediate tables."""

from types import SimpleNamespace

import pytest

from tracklore.session import shared_folder, stage


def fake(master, settings):
    conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_cluster_names_the_folder():
    assert shared_folder(fake("yarn", {"spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"
    with pytest.raises(RuntimeError):
        shared_folder(fake("spark://host:7077", {}))


def test_a_local_session_keeps_one_folder_of_its_own():
    settings = {}
    folder = shared_folder(fake("local[2]", settings))
    assert settings["spark.checkpoint.dir"] == folder == shared_folder(fake("local[2]", settings))


def test_staged_rows_read_back_pruned(spark):
    staged = stage(spark.range(10).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert staged.agg({"twice": "sum"}).first()[0] == 90
    plan = staged.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan
