"""Pinned tables."""

from iotrail.session import pin, release


def test_pinned_tables_can_be_released(spark):
    table = pin(spark.range(10))
    assert table.count() == 10
    folder = table.inputFiles()[0].rsplit("/", 2)[0]
    release(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert pin(spark.range(3)).count() == 3
