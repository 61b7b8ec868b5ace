"""Mixing sources to target weights by hash-threshold histograms.

Each document has a place on a line of 60 bits, from a digest of its identifier and text, and of its number among rows equal
in both. Tokens are summed by source and
hash bucket; the bucket in which a source's budget runs out is refined into finer buckets, until it holds one
place, and documents below the threshold are taken. Nothing is sorted but histograms of a fixed number of buckets.
Thresholds for growing budgets are nested: a smaller mix is a part of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.scans import join_groups, numbered, prefix_sums

from .common import n_words, written

#: Bits of a place; each round refines by BITS of them.
PLACE_BITS, BITS = 60, 12
#: Equal rows that one task numbers, about.
BLOCK = 2000


def place(*keys: Column) -> Column:
    """A place from 0 to 2^60 - 1, the first 15 hexadecimal digits of the MD5 of the keys' texts."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, total -> source, total, target.

    Sources in code point order, null last, have the weights in turn and divide share of all sizes. A target stops
    at most times its source's total; what is over is shared again by weight until no target is above. In the order of that
    limit by weight, the sources that stop are the first ones; sums over those before each tell how many. One number moves to
    the driver.
    """
    turn = numbered(sizes.select("source", "total"), [F.col("source").asc_nulls_last()], "turn")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    table = written(turn.withColumn("weight", weight).withColumn("most", F.col("total") * F.lit(float(most))), "mix-sources")
    budget, open_weight = table.agg(F.sum("total") * F.lit(float(share)), F.sum("weight")).first()
    if budget is None:
        return table.select("source", "total", F.lit(0.0).alias("target"))
    # The rate at which sources that are still open would share, if all before them stop.
    order = [(F.col("most") / F.col("weight")).asc(), F.col("turn").asc()]
    steps = prefix_sums(table, order, {"held": F.col("most"), "used": F.col("weight")})
    rate = F.try_divide(F.lit(float(budget)) - F.col("held"), F.lit(float(open_weight)) - F.col("used"))
    first_open = steps.withColumn("rate", rate).where(F.col("most") > F.col("weight") * F.col("rate")).agg(F.max("rate")).first()[0]
    own = F.col("most") if first_open is None else F.least("most", F.col("weight") * F.lit(float(first_open)))
    return table.select("source", "total", own.alias("target"))


def _thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (source, place, size), goals (source, rest double) -> source, threshold: the sum of sizes at places below it is as near to rest as documents allow.

    Each round reads only rows of the boundary buckets of the round before.
    """
    state = goals.select("source", "rest", F.lit(0).cast("long").alias("low"))
    for done in range(0, PLACE_BITS, BITS):
        width = PLACE_BITS - done - BITS
        bucket = F.shiftright("place", width)
        inside = rows if not done else rows.join(state.select("source", "low"), "source", "inner").where(F.shiftright("place", width + BITS) == F.shiftright("low", width + BITS)).drop("low")
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        up = Window.partitionBy("source").orderBy("bucket")
        sums = hist.withColumn("upto", F.sum("size").over(up)).join(state, "source")
        # The first bucket that brings the sum to rest or beyond it holds the threshold; its places come next.
        edge = sums.groupBy("source").agg(
            F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "size"))).alias("at"), F.max("bucket").alias("end"), F.max("upto").alias("sum"), F.first("rest").alias("rest")
        )
        # Rounding can leave a rest above all that is there: the end is then the threshold.
        at = F.coalesce("at.bucket", "end")
        state = written(edge.select("source", (F.col("rest") - F.coalesce("at.before", "sum")).alias("rest"), F.shiftleft(at, width).alias("low"), F.col("at.size").alias("size")), "mix-edges")
        if not width:
            # One place is left: take it if that comes nearer.
            take = (F.col("size").isNull()) | (F.col("rest") * 2 >= F.col("size"))
            return state.select("source", (F.col("low") + F.when(take, 1).otherwise(0)).alias("threshold"))
        state = state.drop("size")
    raise AssertionError


def _name(source: Column) -> Column:
    """Joins on a source must match null with null: every name has one letter more in front."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """rows (source, size, place) -> name, total, target, base, threshold: a row for each source."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("total"))
    goals = targets(totals, weights, share, most).withColumn("base", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long"))
    goals = written(goals.select(_name(F.col("source")).alias("source"), "total", "target", "base"), "mix-goals")
    rest = F.col("target") - F.col("base") * F.col("total")
    wanted = goals.where((F.col("total") > 0) & (rest > 0)).select("source", rest.alias("rest"))
    limits = _thresholds(rows.where("size > 0").select(_name(F.col("source")).alias("source"), "place", "size"), wanted)
    return written(goals.join(limits, "source", "left").withColumnRenamed("source", "name"), "mix-plan")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *also: Column) -> DataFrame:
    """source, key (what tells rows apart), at (a number of the row), also."""
    text, source = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{source_col}`").cast("string")
    key = F.struct(_name(F.col(f"`{id_col}`")).alias("id"), F.md5(text).alias("h"), _name(source).alias("s"))
    return docs.select(source.alias("source"), key.alias("key"), F.monotonically_increasing_id().alias("at"), *also)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame | None]:
    """source, key, at, id, size of each row; keys that several rows have, with their number n, or None."""
    rows = written(_keyed(docs, id_col, text_col, source_col, F.col(f"`{id_col}`").alias("id"), n_words(F.col(f"`{text_col}`")).alias("size")), "mix-rows")
    again = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "mix-repeated")
    return rows, again if again.limit(1).count() else None


def _placed(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows with place, without key and at. Equal rows are numbered, in blocks, so that no task has to see all of them."""
    if again is None:
        return rows.withColumn("place", place(F.col("key.id"), F.col("key.h"))).drop("key", "at")
    single = rows.join(again, "key", "left_anti").withColumn("place", place(F.col("key.id"), F.col("key.h")))
    total = again.agg(F.sum("n")).first()[0]
    equal = join_groups(rows, again, ["key"], total, "n", ["at"]).withColumn("block", F.pmod("at", F.ceil(F.col("n") / BLOCK)))
    counts = equal.groupBy("key", "block").agg(F.count("*").alias("c"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("key", "block").orderBy("at"))
    number = equal.withColumn("no", inside - 1).join(starts, ["key", "block"]).withColumn("no", F.col("no") + F.col("start"))
    first = place(F.col("key.id"), F.col("key.h"))
    later = place(F.col("key.id"), F.col("key.h"), F.col("no"))
    number = number.withColumn("place", F.when(F.col("no") == 0, first).otherwise(later)).drop("n", "block", "start", "no")
    return single.unionByName(number).drop("key", "at")


def _copies() -> Column:
    return (F.coalesce("base", F.lit(0)) + F.coalesce((F.col("place") < F.col("threshold")).cast("long"), F.lit(0))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken.

    copies is how often the mix takes the row (0 to most): all documents of a source as often as its whole total
    goes into its target, and those below the source's threshold once more. Null texts have size 0; null is a
    source of its own. Rows that share an identifier, or have none, have a place each by their text; of rows equal in that too,
    as many are taken as the threshold says, and which ones makes no difference. An empty table gives an empty
    result. Columns beside the three named ones are ignored.
    """
    rows, again = _rows(docs, id_col, text_col, source_col)
    rows = _placed(rows, again) if again is None else written(_placed(rows, again), "mix-places")
    own = rows.withColumn("name", _name(F.col("source"))).join(plan(rows, weights, share, most), "name", "left")
    return own.select("id", "source", "size", F.col("total").alias("source_size"), "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns, whatever their names; mix() says which."""
    rows, again = _rows(docs, id_col, text_col, source_col)
    per_source = plan(_placed(rows, again), weights, share, most)
    own = _placed(_keyed(docs, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), again)
    times = own.withColumn("name", _name(F.col("source"))).join(per_source, "name", "left").select("_row", _copies().cast("int").alias("n")).where("n > 0")
    return times.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("_row.*")
