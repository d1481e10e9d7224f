"""Intermediate tables beside other threads and inside each other."""

import threading

from tracewell.scratch import _CLEANUP, cut, cut_alone


def test_tables_of_other_threads_stay(spark):
    kept, inside, done = [], threading.Event(), threading.Event()

    def other():
        inside.wait(30)
        kept.append(cut(spark.range(7), "t-other"))
        done.set()

    t = threading.Thread(target=other)
    t.start()
    on_the_way = []

    def make():
        on_the_way.append(cut(spark.range(3), "t-way"))
        inside.set()
        done.wait(60)
        return on_the_way[0]

    before = spark.conf.get(_CLEANUP, "false")
    out = cut_alone(spark, make, "t-out")
    t.join()
    assert kept[0].count() == 7 and out.count() == 3
    assert not spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(out._scratch).isEmpty()
    fs = spark._jvm.org.apache.hadoop.fs.Path(on_the_way[0]._scratch)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    assert spark.conf.get(_CLEANUP, "false") == before


def test_nested(spark):
    inner = []

    def make():
        inner.append(cut_alone(spark, lambda: cut(spark.range(4), "t-a"), "t-inner"))
        return inner[0].selectExpr("id + 1 AS id")

    out = cut_alone(spark, make, "t-outer")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4]
    fs = spark._jvm.org.apache.hadoop.fs.Path(inner[0]._scratch)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
