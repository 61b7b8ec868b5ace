"""Images that are put into a folder are triaged once."""

import shutil

import pytest
from pyspark.sql import SparkSession

from tracewell import fixtures
from tracewell.streaming import drop_folder


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def test_each_image_once(spark, tmp_path):
    folder, target, at = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/at"
    folder.mkdir()
    (folder / "a b.dd").write_bytes(fixtures.disk())
    (folder / "note.txt").write_text("no image")
    for _ in range(2):
        drop_folder.watch(spark, str(folder), target, at, once=True).awaitTermination(300)
    assert [r.image.rpartition("/")[2] for r in spark.read.parquet(f"{target}/documents").collect()] == ["a b.dd"]
    shutil.copy(folder / "a b.dd", folder / "c.raw")
    drop_folder.watch(spark, str(folder), target, at, once=True).awaitTermination(300)
    assert sorted(r.image.rpartition("/")[2] for r in spark.read.parquet(f"{target}/documents").collect()) == ["a b.dd", "c.raw"]
    assert spark.read.parquet(f"{target}/summary").count() == 4
