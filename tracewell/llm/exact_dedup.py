"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters of (first bytes of the content, 8 bytes of its SHA-256, identifier) and sorted
inside each partition, by these and the whole content, by Spark's external sort, so equal contents are adjacent. The identifier
is part of the splitters: a content that holds a third of all rows is spread over many partitions. Neighbours are compared in
full. Only the first and the last run of a partition can go on in another one; a row of each, two for each partition, is grouped
by whole content, and what comes out, without contents, is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of the content and of its digest in a splitter: they bound what the sampling sends to the driver.
PREFIX, DIGEST = 24, 8

#: run: of a run that may go on in another partition, its number; content stands in the last row of such a run.
SCHEMA = "id long, digest string, top long, n long, last boolean, run string, content binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by content and identifier -> the run of equal contents that each row is in."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(["id", "digest", "top", "n", "last", "run", "content"], types, strict=True)))
    ids: list = []  # of the open run
    content, digest, part, first = None, None, 0, True

    def close(end: str | None) -> pa.RecordBatch:
        n, run = len(ids), None if end is None else f"{part}{end}"
        cols = [ids, [digest] * n, [ids[-1]] * n, [n] * n, [False] * (n - 1) + [True], [run] * n, [None] * (n - 1) + [content if run else None]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        text, id_col, digests = (batch.column(batch.schema.get_field_index(c)) for c in ("content", "id", "digest"))
        part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
        same = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_pylist()
        id_list = id_col.to_pylist()
        starts = [0, *(i + 1 for i, s in enumerate(same) if not s), len(id_list)]
        done: list[pa.RecordBatch] = []
        for a, b in zip(starts, starts[1:], strict=False):
            head = text[a].as_py()
            if ids and head == content:
                ids += id_list[a:b]
                continue
            if ids:
                done.append(close("a" if first else None))
                first = False
            ids, content, digest = id_list[a:b], head, digests[a].as_py()
        yield from done
    if ids:
        yield close("a" if first else "z")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "min", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest (SHA-256 of the normalised content, hex).

    Null content counts as empty. Texts are compared as they are, or as normalise makes them. Of equal contents the row with the smallest identifier stays (keep="max": the
    largest); of rows that also share the identifier, one stays. A null identifier is below every other one for
    "max" and above for "min", so it stays only if all are null. An empty table gives an empty result; columns
    beside the two named ones are ignored.
    """
    content = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    content = (normalise(content) if normalise else content).cast("binary")
    # Ascending by the turned identifier, the row that stays is always the last of its run.
    turned = (lambda c: c) if keep == "max" else F.bitwise_not
    rows = docs.select(turned(F.col(f"`{id_col}`").cast("long")).alias("id"), content.alias("content"))
    rows = rows.select("id", "content", F.sha2("content", 256).alias("digest"), F.substring("content", 1, PREFIX).alias("prefix"))
    rows = rows.withColumn("mark", F.unhex(F.substring("digest", 1, 2 * DIGEST)))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "prefix", "mark", F.col("id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions("prefix", "mark", "content", F.col("id").asc_nulls_first())
    runs = written(ordered.select("id", "content", "digest", F.spark_partition_id().alias("part")).mapInArrow(_runs, SCHEMA), "exact-runs")
    # Two rows for each partition: runs with equal contents are one group, in which one run's last row stays.
    heads = runs.where("last AND run IS NOT NULL").select("run", "content", "top", "n")
    best = F.max(F.struct(F.col("top").isNotNull().alias("some"), "top", "run"))
    whole = heads.groupBy("content").agg(best.alias("best"), F.sum("n").alias("all_n"))
    ends = heads.select("run", "content").join(whole, "content").select("run", F.col("best.top").alias("all_top"), "all_n", (F.col("best.run") == F.col("run")).alias("wins"))
    out = runs.drop("content").join(F.broadcast(ends), "run", "left")
    edge = F.col("run").isNotNull()
    keep, size = F.when(edge, F.col("all_top")).otherwise(F.col("top")), F.when(edge, F.col("all_n")).otherwise(F.col("n"))
    return out.select(turned(F.col("id")).alias("id"), turned(keep).alias("keep_id"), size.cast("long").alias("group_size"), (F.col("last") & F.coalesce("wins", F.lit(True))).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, with all columns whatever their names, without the rows that exact_groups() doesn't keep; of rows with one identifier and content one stays.

    Null contents are empty ones; an empty table stays empty.
    """
    kept = exact_groups(docs, id_col, text_col, **how).where("kept").select(F.col("id"), F.col("digest"))
    normalise = how.get("normalise")
    content = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    mine = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("_id"), F.sha2((normalise(content) if normalise else content).cast("binary"), 256).alias("_digest"))
    joined = mine.join(kept, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    return joined.dropDuplicates(["_id", "_digest"]).select("_row.*")
