"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt by hash into groups of a bounded number of pieces, and each group is packed by itself: longest
first, every piece goes where the least room is left. When no open bin has room, of all permitted lengths that one is opened
which costs least for each token that it will hold; packings that open no bin below a given length are tried too, and the
group's cheapest packing stays. At the end each bin is downsized to the smallest length that holds its contents. Only identifiers and sizes are moved, not texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, written

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces in a group, about; a group is packed in memory.
GROUP = 20_000
#: Cost of a sequence of n tokens: n and a fixed overhead.
OVERHEAD = 16

SCHEMA = "id long, key long, piece int, start long, size long, bin_id long, bin_length int, bin_used int, bin_offset int"


def cost(length: int) -> int:
    return length + OVERHEAD


def best_fit(sizes: Sequence[int], lengths: Sequence[int], opens: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """sizes, none above the largest length -> the bin of each, its offset there, the length of each bin after downsizing.

    A piece takes the bin with the least room that holds it. If none does, the bin size with the least cost for each token that
    it would hold is opened: the piece, and as much of what is still to be placed as has room. Of equal ones the longest is.
    opens: the smallest length to open instead, if the piece would fit.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms: list[int] = []  # distinct rooms left, ascending
    by_room: dict[int, list[int]] = {}
    where, offset, used = [0] * len(sizes), [0] * len(sizes), []
    left_over = sum(sizes)
    for i in order:
        s = sizes[i]
        left_over -= s
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[k]
        else:
            b = len(used)
            used.append(0)
            if opens is None:
                fit = [x for x in lengths if x >= s]
                room = min(fit, key=lambda x: (cost(x) / (s + min(x - s, left_over)), -x))
            else:
                room = next(x for x in lengths if x >= max(s, opens))
        where[i], offset[i] = b, used[b]
        used[b] += s
        left = room - s
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return where, offset, [next(x for x in lengths if x >= u) for u in used]


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of best_fit() with the least-cost choice at each opening, and with every smallest length to open; of equal ones, the first."""
    tries = [best_fit(sizes, lengths), *(best_fit(sizes, lengths, opens) for opens in sorted(lengths, reverse=True))]
    return min(tries, key=lambda t: sum(map(cost, t[2])))


def _pack_group(lengths: tuple[int, ...]):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("key", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        sizes = table.column("size").to_pylist()
        where, offset, kept = pack_sizes(sizes, lengths)
        used = [0] * len(kept)
        for b, s in zip(where, sizes, strict=True):
            used[b] += s
        group = table.column("grp")[0].as_py() if len(sizes) else 0
        own = [table.column(c).cast(t) for c, t in (("id", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64()))]
        bins = [pa.array([group * (1 << 32) + b for b in where], pa.int64()), *(pa.array(x, pa.int32()) for x in ([kept[b] for b in where], [used[b] for b in where], offset))]
        return pa.table([*own, *bins], names=["id", "key", "piece", "start", "size", "bin_id", "bin_length", "bin_used", "bin_offset"])

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, lengths: Sequence[int] = LENGTHS, group: int = GROUP) -> DataFrame:
    """One row per piece of a document: id, piece, start, size, bin_id, bin_length, bin_used, bin_offset.

    size: a column of tokens a document (default: its words). A document longer than the longest bin is cut into
    full pieces and a rest. Null and empty texts have no tokens and one piece of size 0 in no bin (bin_id null).
    Repeated rows are packed each. An empty table gives an empty result; further columns are ignored.
    """
    top = max(lengths)
    n = n_words(F.col(text_col)) if size is None else size.cast("long")
    sized = written(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.coalesce(n, F.lit(0)).cast("long").alias("n")), "pack-sizes")
    total = sized.select(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = sized.select("id", "key", "n", F.monotonically_increasing_id().alias("row"), F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("id", "key", "row", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(top)).cast("long").alias("size"))
    # Repeated rows differ in their place in the written table, so a group's size depends on the number of pieces only.
    dealt = pieces.where("size > 0").withColumn("grp", F.pmod(F.xxhash64("id", "key", "piece", "row"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("grp").applyInArrow(_pack_group(tuple(lengths)), SCHEMA)
    none = pieces.where("size = 0").select("id", "key", "piece", "start", "size", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_used"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(none).drop("key")
