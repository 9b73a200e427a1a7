"""What is written on a query's way."""

import os

from lectern.llm import session


def test_written_tables_go_with_the_driver(spark):
    rows = session.written(spark.range(10).repartition(3))
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert rows.count() == 10 and os.path.isdir(path.removeprefix("file://").removeprefix("file:"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.cancelDeleteOnExit(at)  # it was to be deleted
    assert spark.conf.get(session.CLEANUP) == "false"
    session.remove(spark, path)
    assert not files.exists(at)
