"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.plans import analogues

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(analogues.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    got = analogues.queries()[name](spark, SF).toPandas()
    want = con.execute(analogues.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_one_place_rounds_exact_values(spark):
    r = random.Random(4)
    ties = [k / 20 for k in range(-2000, 2000)] + [k + 0.25 * j for k in (0, 7, 1 << 40, 1 << 50) for j in range(4)]
    some = [*ties, *(math.nextafter(x, to) for x in ties for to in (-1e9, 1e9)), *(r.uniform(0, 10.0 ** r.randrange(-3, 18)) for _ in range(2000)), 0.0, -0.0, 2.0**53 + 2, 2.0**61, 1e-320]
    rows = spark.createDataFrame([(x,) for x in some], "x double").select("x", scalars.one_place(F.col("x")).alias("text")).collect()
    assert [r.text for r in rows] == [f"{r.x:.1f}" for r in rows]


def test_speeds_of_large_tables_match_sql(spark, tmp_path):
    # Prices whose speeds end in a half, or next to one.
    orders = [(k, k, 1000.0 * (k // 4) + (50.0, 150.0, 250.0, 358650.0)[k % 4]) for k in range(1, 2000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert _rows(analogues.queries()["report_texts"](spark, str(tmp_path)).toPandas()) == _rows(con.execute(analogues.oracle_sql()["report_texts"]).df())


def test_late_filetimes_match_sql(spark, tmp_path):
    keys = [0, 1, 2534022, 2534023, 2534024, 2534025, 8999999, 9000000, 9106000]
    spark.createDataFrame([(k,) for k in keys], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert _rows(analogues.queries()["filetime_ts"](spark, str(tmp_path)).toPandas()) == _rows(con.execute(analogues.oracle_sql()["filetime_ts"]).df())


def test_compress_ratio(spark):
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in analogues.queries()["compress_ratio"](spark, SF).collect():
        raw = texts[r.doc_id]
        sample = raw[:1024] + raw[len(raw) // 2 : len(raw) // 2 + 1024]
        want = len(zlib.compress(sample, 1)) / len(sample) if sample else 1.0
        assert abs(r.ratio - want) < 1e-6 and r.stored == (want >= 0.97)
