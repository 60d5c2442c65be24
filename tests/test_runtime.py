import os

import pytest

from pathloom import runtime


def test_written_tables_live_in_the_scratch_folder_until_dropped(spark):
    df = runtime.written(spark.range(10), "numbers")
    assert df.count() == 10 and runtime.scratch_root(spark).removeprefix("file://").rstrip("/") in df.inputFiles()[0]
    root = runtime.scratch_root(spark)
    assert root == runtime.scratch_root(spark) and spark.sparkContext.getCheckpointDir()
    runtime.drop_scratch(spark)
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))
    assert not [f for f in files if f"numbers-{os.getpid()}-" in f.getPath().getName()]


def test_package_reaches_the_workers(spark):
    runtime.ship(spark)
    got = spark.range(2).rdd.map(lambda _: __import__("pathloom.functions.grammar").functions.grammar.representable((0, 1), 2)).collect()
    assert got == [True, True]


def test_no_silent_folder_on_a_cluster():
    assert runtime.is_local("local") and runtime.is_local("local[8]") and runtime.is_local("local[*, 4]")
    assert not any(map(runtime.is_local, ("yarn", "spark://a:7077", "k8s://https://a", "local-cluster[2,1,1024]")))


def test_scratch_is_refused_without_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.scratch_root(type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, *a: None})()})())


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(1, k) for k in range(95)] + [(2, 200), (None, 300)], "k int, x int")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, y string")
    got = sorted((r.k, r.x, r.y) for r in runtime.hot_joined(rows, other, ["k"]).collect())
    assert got == sorted([(1, k, y) for k in range(95) for y in "ab"] + [(2, 200, "c")])
    assert runtime.hot_joined(rows.limit(0), other, ["k"]).count() == 0


def test_a_written_table_can_be_discarded(spark):
    a, b = runtime.written(spark.range(5), "gone"), runtime.written(spark.range(7), "kept")
    files = a.inputFiles()
    runtime.discard(a)
    assert b.count() == 7 and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        a.count()
