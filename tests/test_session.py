"""Scratch tables: written, read, deleted."""

import os

from pagelake.session import discard, stored


def test_discarded_tables_leave_no_files(spark):
    df = stored(spark.range(10), "gone")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 10 and os.path.isdir(folder)
    discard(df)
    assert not os.path.exists(folder)


def test_tables_elsewhere_stay(spark, tmp_path):
    path = str(tmp_path / "kept")
    spark.range(3).write.parquet(path)
    discard(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3
