"""Running sums, row numbers and joins with groups that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import cut

#: Rows of a group that one task may get at least; a group beyond this and beyond a 5,000th of all rows is dealt out.
LEAST_HOT, SHARE = 1000, 5000


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows before.

    Rows are range-partitioned and sorted by order, which must tell them apart; sums within a partition start from the sums
    of the partitions before, of which there is a row each. Null counts as 0. An empty table stays empty.
    """
    own = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    dealt = df.withColumns(own).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "prefix-rows")
    parts = dealt.groupBy("_p").agg(*(F.sum(n).alias(n) for n in own))
    # A row for each partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(parts.select("_p", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}s") for n in own)))
    within = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(starts, "_p").withColumns({name: F.col(f"{n}s") + F.coalesce(F.sum(n).over(within), F.lit(0)) for name, n in zip(sums, own, strict=True)})
    return out.drop("_p", "_i", *own, *(f"{n}s" for n in own))


def numbered(df: DataFrame, order: Sequence[Column], out: str = "number") -> DataFrame:
    """df with the number of rows before each in the order, from 0."""
    return prefix_sums(df, order, {out: F.lit(1).cast("long")})


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], total: int, size: str = "n", spread: Sequence[str] = ()) -> DataFrame:
    """rows joined with the row of their group in groups (by, size, ...), inner.

    The rows of a group whose size is beyond the larger of LEAST_HOT and total / SHARE are dealt out by spread to as many
    tasks as it takes, and its row is copied to each. There are SHARE such groups at most, so their list is broadcast. by must
    not be null.
    """
    most = max(LEAST_HOT, total // SHARE)
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    hot = F.broadcast(groups.where(F.col(size) > most).select(*by, parts.alias("_parts")))
    dealt = rows.join(hot, list(by), "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts"))).cast("int")).drop("_parts")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, parts - 1).otherwise(0))))
    return dealt.join(copies, [*by, "_salt"]).drop("_salt")
