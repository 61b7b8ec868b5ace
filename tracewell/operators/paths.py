"""Paths of rows that name their parent."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session. Only a session in one process gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that its plan ends there and lost executors cost no recomputation."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tracewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resolve(df: DataFrame, key: Sequence[str], parent: Sequence[str], name: str, sep: str = "/", levels: int = 64) -> DataFrame:
    """df's keys with path, the names from a root down. Roots have a null parent column.

    Keys must be unique. Rows are left out whose ancestors miss a row, form a cycle, or are more than levels (a power of two). Every round joins
    rows with what they point to and doubles the levels that a pointer spans, so the rounds grow with the
    logarithm of the depth. Rows that many point to are copied to several tasks.
    """
    from .scans import join_groups

    up, above = [f"_up{i}" for i in range(len(key))], [f"_above{i}" for i in range(len(key))]
    step = df.select(*key, *(F.col(p).alias(u) for p, u in zip(parent, up, strict=True)), F.col(name).alias("path"))
    root = F.greatest(*(F.col(u).isNull().cast("int") for u in up), F.lit(0)) == 1
    span = 1
    while span < levels:
        step = cut(step, "paths")
        pointing = step.where(~root)
        left = pointing.count()
        if not left:
            break
        far = step.select(*(F.col(k).alias(u) for k, u in zip(key, up, strict=True)), *(F.col(u).alias(a) for u, a in zip(up, above, strict=True)), F.col("path").alias("_front"))
        sizes = pointing.groupBy(*up).agg(F.count("*").alias("_size"))
        met = join_groups(pointing, far.join(sizes, up), up, left, "_size", key)
        moved = met.select(*key, *(F.col(a).alias(u) for a, u in zip(above, up, strict=True)), F.concat("_front", F.lit(sep), "path").alias("path"))
        step, span = step.where(root).unionByName(moved), span * 2
    return step.where(root).select(*key, "path")
