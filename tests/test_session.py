"""Tables in the shared folder: what a block deletes, and what it leaves to others."""

import threading

from strataloom.session import materialize, scratch, sweep


def test_a_block_deletes_its_own_tables_only(spark):
    before = materialize(spark.range(5), "kept")
    inside, done, other = threading.Event(), threading.Event(), []

    def elsewhere():
        inside.wait(60)
        other.append(materialize(spark.range(7), "kept"))
        done.set()

    thread = threading.Thread(target=elsewhere)
    thread.start()
    with scratch(spark):
        own = materialize(spark.range(3), "gone")
        with scratch(spark):
            inner = materialize(spark.range(4), "gone")
            assert inner.count() == 4
        assert own.count() == 3
        inside.set()
        assert done.wait(60)
    thread.join()
    assert before.count() == 5 and other[0].count() == 7
    folder = own.inputFiles()[0].rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert not there()


def test_sweep_forgets_what_it_deleted(spark):
    from strataloom import session

    known = list(session._written)
    session._written.clear()
    try:
        materialize(spark.range(2), "swept")
        sweep(spark)
        sweep(spark)
        assert session._written == []
    finally:
        session._written.extend(known)
