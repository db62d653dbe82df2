"""Where intermediate tables may go."""

from types import SimpleNamespace

import pytest

from labelspark.session import shared_folder, written


def fake(master, folder):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_follows_the_session():
    assert shared_folder(fake("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/labelspark/x-")
    assert shared_folder(fake("local[2]", None), "x") != shared_folder(fake("local[2]", None), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake("yarn", None), "x")


def test_written_tables_are_new_paths(spark):
    df = spark.range(5)
    one, two = written(df, "t"), written(df, "t")
    assert one.inputFiles() != two.inputFiles() and one.count() == two.count() == 5
