"""Paths against a walk of the parents."""

import pytest
from pyspark.sql import SparkSession

from tracewell.operators import paths


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


@pytest.mark.parametrize("levels", [4, 64])
def test_resolve(spark, levels):
    parent = {1: None, **{k: k // 2 for k in range(2, 40)}, 100: 999, 101: 102, 102: 101, 103: 103, 104: 100}
    got = {r.id: r.path for r in paths.resolve(spark.createDataFrame([(k, p, f"n{k}") for k, p in parent.items()], "id long, up long, name string"), ["id"], ["up"], "name", "\\", levels).collect()}

    def walk(k):
        names = []
        while k is not None:
            if k not in parent or len(names) == levels:
                return None
            names.append(f"n{k}")
            k = parent[k]
        return "\\".join(names[::-1])

    assert got == {k: w for k in parent if (w := walk(k))}


def test_resolve_nothing(spark):
    assert paths.resolve(spark.createDataFrame([], "id long, up long, name string"), ["id"], ["up"], "name").collect() == []
