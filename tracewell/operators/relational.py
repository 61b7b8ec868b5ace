"""Relational operators of triage and acquisition, as functions of DataFrames with column names as parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .paths import cut
from .scans import prefix_sums


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle as well."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def recent_files(df: DataFrame, folder: str, order: Sequence[Column], per_folder: int = 3, total: int = 15) -> DataFrame:
    """The newest rows over all folders, of which none gives more than per_folder, with their rank."""
    top = top_per_group(df, [folder], order, per_folder).orderBy(*order).limit(total)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def latest_by(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """For each key the row with the largest order columns, by one partial and one final aggregation."""
    s = df.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("_m"))
    return s.select(key, *(F.col(f"_m.{c}").alias(c) for c in dict.fromkeys([*order, *keep])))


def islands(df: DataFrame, value: str, parts: int = 1 << 20, by: Sequence[str] = ()) -> DataFrame:
    """by, start, count of runs of consecutive distinct values.

    Values are cut into blocks, so that no task sees all of them, and runs are found in each. A run that touches its block's
    first or last value may go on in a neighbour: blocks have two such runs at most. A block that is full from end to end is
    passed over by a running number of the ends before, in range partitions.
    """
    block = scalars.whole(F.col("v"), parts)
    v = df.select(*by, F.col(value).cast("long").alias("v")).distinct().withColumn("block", block)
    rn = v.withColumn("g", F.col("v") - F.row_number().over(Window.partitionBy(*by, "block").orderBy("v")))
    runs = cut(rn.groupBy(*by, "block", "g").agg(F.min("v").alias("start"), F.max("v").alias("end")).drop("g"), "islands")
    first, last = F.col("block") * parts, (F.col("block") + 1) * parts - 1
    touches = (F.col("start") == first) | (F.col("end") == last)
    inner = runs.where(~touches).select(*by, "start", (F.col("end") - F.col("start") + 1).alias("count"))
    edge = runs.where(touches)
    # A run begins where no run of the block before ends right before it.
    before = edge.where(F.col("end") == last).select(*by, (F.col("end") + 1).alias("start"), F.lit(False).alias("new"))
    marked = edge.join(before, [*by, "start"], "left").withColumn("new", F.coalesce("new", F.lit(True)))
    order = [*(F.col(c) for c in by), F.col("start")]
    counted = prefix_sums(marked, order, {"begun": F.col("new").cast("long")})
    run = F.col("begun") + F.col("new").cast("long")
    joined = counted.withColumn("run", run).groupBy(*by, "run").agg(F.min("start").alias("start"), F.sum(F.col("end") - F.col("start") + 1).alias("count"))
    return inner.unionByName(joined.drop("run"))


def with_leftovers(profiles: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    """profiles with their accounts' columns, then the accounts that no profile names."""
    left = profiles.join(accounts, key, "left")
    return left.unionByName(accounts.join(profiles.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def running_offset(df: DataFrame, length: str, order: str, out: str = "start") -> DataFrame:
    """Where each segment begins: the lengths before it, summed over range partitions."""
    return prefix_sums(df, [F.col(order)], {out: F.col(length)})


def locate(points: DataFrame, at: str, segments: DataFrame, start: str, length: str) -> DataFrame:
    """points with the segment that holds them: both sides are cut into blocks and joined on the block, then refined."""
    width = 1 << 16
    seg = segments.where(F.col(length) > 0).withColumn("_b", F.explode(F.sequence(scalars.whole(F.col(start), width), scalars.whole(F.col(start) + F.col(length) - 1, width))))
    return points.withColumn("_b", scalars.whole(F.col(at), width)).join(seg, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length))).drop("_b")


def trailing_rate(df: DataFrame, key: str, t: str, value: str, span: int) -> DataFrame:
    """Change of value per unit of t, from the oldest row at most span back, or the row before if that is the only one."""
    w = Window.partitionBy(key).orderBy(t)
    near = w.rangeBetween(-span, 0)
    one = F.count(F.lit(1)).over(near) == 1
    t0 = F.when(one, F.lag(t).over(w)).otherwise(F.first(t).over(near))
    v0 = F.when(one, F.lag(value).over(w)).otherwise(F.first(value).over(near))
    return df.withColumn("rate", F.try_divide((F.col(value) - v0).cast("double"), (F.col(t) - t0).cast("double")))


def is_noise(name: Column, names: Sequence[str], prefixes: Sequence[str], suffixes: Sequence[str]) -> Column:
    low = F.lower(name)
    out = low.isin(*names)
    for p in prefixes:
        out = out | low.startswith(p)
    for s in suffixes:
        out = out | low.endswith(s)
    return out


def key_values(df: DataFrame, key: str, text: str, between: str) -> DataFrame:
    """key, name, value of the name=value pairs in a text; of pairs with equal names the last one counts."""
    pairs = df.select(key, F.posexplode(F.split(text, between)).alias("_k", "_pair")).where(F.instr("_pair", "=") > 1)
    at = F.instr("_pair", "=")
    named = pairs.select(key, "_k", F.substring("_pair", F.lit(1), at - 1).alias("name"), F.substring("_pair", at + 1, F.length("_pair")).alias("value"))
    return named.groupBy(key, "name").agg(F.max_by("value", "_k").alias("value"))


def dirs_first(df: DataFrame, name: str, kind: str, folder: Sequence[str] = ()) -> DataFrame:
    """The rows of each listing with their rank: folders first, then by name without regard to case.

    Without folder columns all rows are one listing, which one task ranks: for listings, not for whole tables.
    """
    w = Window.partitionBy(*folder).orderBy(F.col(kind) != "dir", F.lower(name), name)
    return df.withColumn("rank", F.row_number().over(w).cast("long"))


def findings(parts: Sequence[DataFrame]) -> DataFrame:
    """The parts one after another, with their number as seq."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("seq", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out
