"""Line dedup by a suffix array over line identifiers, built by distributed prefix doubling.

Lines with words are the letters of one long sequence; a text's end ends all runs. A suffix's rank among those that agree in
their first 2^(k+1) lines follows from the ranks, at 2^k lines, of the suffix and of the one 2^k lines on: distinct pairs of ranks
are range-partitioned and numbered in order. Suffixes whose first 2^k lines stand nowhere else are settled and drop out, and
doubling goes on until all are.

Longest-common-prefix intervals are sets of suffixes that share a prefix, with its length and its first place. A suffix's
interval is the longest that has an earlier place in it: the last rank at which the suffix is not the first of its group gives the
length up to a factor of two, and halving the step finds the rest, as suffixes with one rank are split by the rank that stands
where the longer prefix would end. A run that isn't part of one that begins a line before is a maximal repeated run. Every
maximal run of MIN_WORDS words or more is a later copy, and is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.scans import join_groups

from .common import discard, written

#: Words that a repeated run must have to be deleted.
MIN_WORDS = 5

#: A text, and a line's place: none (no identifier), d (identifier), k (hash of the text), i (line with words, from 0).
TEXT, PLACE = ["none", "d", "k"], ["none", "d", "k", "i"]
_LINES = "none boolean, d long, k long, i int, h1 long, h2 long, before long, after long"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("none", pa.bool_()), *((c, pa.int64()) for c in ("d", "k")), ("i", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "before", "after"))])

    def out(cols: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    cols: list[list] = [[] for _ in schema]
    for batch in batches:
        for none, d, k, text in zip(*(batch.column(c).to_pylist() for c in ("none", "d", "k", "text")), strict=True):
            i = before = 0
            for line in text.split(b"\n"):
                # bytes.split() parts words at ASCII white space.
                words = len(line.split())
                if not words:
                    continue
                h = xxhash.xxh3_128_intdigest(line)
                row = (none, d, k, i, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), before, before + words)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
                i += 1
                before += words
                if i % 50_000 == 0:
                    yield out(cols)
                    cols = [[] for _ in schema]
            if len(cols[0]) >= 50_000:
                yield out(cols)
                cols = [[] for _ in schema]
    yield out(cols)


def _place(i: Column | str = "i") -> Column:
    return F.struct(*TEXT, F.col(i).alias("i") if isinstance(i, str) else i.alias("i"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = F.col(f"`{id_col}`").cast("long")
    return [d.isNull().alias("none"), F.coalesce(d, F.lit(0).cast("long")).alias("d"), F.xxhash64(t).alias("k")]


def _ranked(rows: DataFrame, by: list[str], also: list[str] = []) -> DataFrame | None:  # noqa: B006
    """rows (PLACE, by, also) that share by with another row -> PLACE, also, rank (in the order of by), first (place of the group). None if no rows do.

    Groups are counted before they are moved; only distinct values of by are sorted.
    """
    groups = written(rows.groupBy(*by).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    order = groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    # Numbers are fixed once written: a recomputed partition can't change them halfway.
    ranks = written(order, "line-ranks")
    out = written(join_groups(rows, ranks, by, total, "n", PLACE).select(*PLACE, *also, "rank", "first"), "line-suffixes")
    discard(groups, ranks)
    return out


def _on(rows: DataFrame, moved: Column, cols: dict[str, str]) -> DataFrame:
    """The columns of rows that stand at line i where moved says so."""
    return rows.select(*TEXT, moved.alias("i"), *(F.col(c).alias(a) for c, a in cols.items()))


def suffix_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """For k = 0, 1, ... the suffixes whose first 2^k lines stand in several places: PLACE, rank, first.

    Ranks grow with the order of these 2^k lines; equal ranks are equal lines. first is the place of the first such suffix.
    The first table also has before and after, a text's words up to the line. Rows equal in identifier and text are one text.
    """
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    lines = written(docs.select(*_keys(docs, id_col, text_col), t.alias("text")).mapInArrow(_lines, _LINES), "lines")
    sizes = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.count("*").alias("n")).where("first <> last")
    sizes = written(sizes.drop("first", "last"), "line-sizes")
    repeated = join_groups(lines, sizes, ["h1", "h2"], sizes.agg(F.sum("n")).first()[0] or 0, "n", PLACE).drop("n")
    # Repeated rows bring a place several times.
    one = written(repeated.dropDuplicates(PLACE), "line-repeated")
    first = _ranked(one, ["h1", "h2"], ["before", "after"])
    if first is None:
        # No line stands twice: an empty table of its form.
        first = one.where("false").select(*PLACE, "before", "after", F.lit(0).cast("long").alias("rank"), _place().alias("first"))
        return [first]
    ranks = [first]
    discard(lines, sizes, one)
    while True:
        step = 1 << (len(ranks) - 1)
        here = ranks[-1].select(*PLACE, F.col("rank").alias("r1"))
        pairs = here.join(_on(ranks[-1], F.col("i") - step, {"rank": "r2"}), PLACE)
        longer = _ranked(pairs, ["r1", "r2"])
        if longer is None:
            return ranks
        ranks.append(longer)


def prefix_intervals(ranks: list[DataFrame]) -> DataFrame:
    """For each suffix that shares lines with an earlier one: PLACE, n (lines of the longest prefix that an earlier place has), source (the first such place)."""
    level = None
    for k, r in enumerate(ranks):
        r = r.select(*PLACE, F.lit(k).alias("k2"), "rank", "first")
        level = r if level is None else level.unionByName(r)
    later = level.where(F.col("first") < _place())
    # The last level at which a suffix isn't first of its group; source is its group there.
    found = written(later.groupBy(*PLACE).agg(F.max(F.struct("k2", F.col("first").alias("source"))).alias("m")).select(*PLACE, F.col("m.k2").alias("k2"), F.col("m.source").alias("source")).withColumn("n", F.expr("shiftleft(1, k2)")), "line-intervals")
    table, top = level.select(*PLACE, F.col("k2"), F.col("rank")), len(ranks) - 1
    done, state = [found.where("k2 = 0").drop("k2")], found.where("k2 > 0")
    for s in range(1, top + 1):
        half = F.expr(f"shiftright(shiftleft(1, k2), {s})")
        # Each group is split by what stands at the end of the prefix that is longer by half; its first place takes part.
        heads = state.select("source.*", "k2", "n", "source").distinct()
        everyone = state.unionByName(heads).withColumn("half", half)
        at = F.col("i") + F.col("n") + F.col("half") - F.expr("shiftleft(1, k2)")
        asked = everyone.select(*TEXT, at.alias("at"), "i", "k2", "n", "half", "source")
        met = asked.join(table.withColumnRenamed("i", "at"), [*TEXT, "at", "k2"]).drop("at")
        by = ["k2", "n", "source", "rank"]
        groups = written(met.groupBy(*by).agg(F.min(_place()).alias("head"), F.count("*").alias("c")).where("c > 1"), "line-splits")
        split = join_groups(met, groups, by, groups.agg(F.sum("c")).first()[0] or 0, "c", PLACE).where(F.col("head") < _place())
        longer = split.select(*PLACE, "k2", F.col("head").alias("source2"), (F.col("n") + F.col("half")).alias("n2"))
        new = state.join(longer, [*PLACE, "k2"], "left").select(*PLACE, "k2", F.coalesce("source2", "source").alias("source"), F.coalesce("n2", "n").alias("n"))
        state = written(new, "line-intervals")
        done.append(state.where(F.col("k2") == s).drop("k2"))
        state = state.where(F.col("k2") > s)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The maximal repeated runs that are later copies: PLACE, n (lines), words, source (none, d, k, i of the first copy).

    A run can't be longer, to either side, and still have its earlier copy. Runs of fewer than min_words words are left out.
    """
    ranks = suffix_ranks(docs, id_col, text_col)
    intervals = written(prefix_intervals(ranks), "line-intervals")
    # A run that begins a line later in a longer one is part of it.
    maximal = intervals.join(intervals.select(*TEXT, (F.col("i") + 1).alias("i"), (F.col("n") - 1).alias("n")), [*PLACE, "n"], "left_anti")
    starts = maximal.join(ranks[0].select(*PLACE, "before"), PLACE).withColumn("end", F.col("i") + F.col("n") - 1)
    ends = ranks[0].select(*TEXT, F.col("i").alias("end"), "after")
    counted = starts.join(ends, [*TEXT, "end"]).withColumn("words", F.col("after") - F.col("before"))
    return counted.where(F.col("words") >= min_words).select(*PLACE, "n", "words", "source")


def _without(text: str | None, runs: list | None) -> tuple[str, list[int]] | None:
    """The text without the runs, each from a line with words on, and the numbers of the lines deleted."""
    if text is None or runs is None:
        return None
    lines, left = text.split("\n"), sorted((r["i"], r["n"]) for r in runs)
    kept, gone, i, upto, k = [], [], 0, 0, 0
    for no, line in enumerate(lines):
        if line.encode("utf-8", "surrogatepass").split():
            while k < len(left) and left[k][0] <= i:
                upto = max(upto, sum(left[k]))
                k += 1
            i += 1
            if i <= upto:
                gone.append(no)
                continue
        kept.append(line)
    return "\n".join(kept), gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from the text, and column dropped_lines (array of int) put on.

    dropped_lines are numbers of lines (parts between newlines, from 0), ascending, empty if the text is as it was. The first
    copy is that with the smallest identifier, then line; null identifiers come last. Of texts that share an identifier, the
    one with the smaller hash comes first; rows equal in identifier and text are one text. Lines without words are never counted
    or deleted; null texts stay null. Other columns stay as they are, whatever their names, but that one named
    dropped_lines is replaced; an empty table stays empty.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words)
    per_text = runs.groupBy(*TEXT).agg(F.collect_list(F.struct("i", "n")).alias("_runs"))
    names = [c for c in docs.columns if c != "dropped_lines"]
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), *_keys(docs, id_col, text_col)).join(per_text, TEXT, "left")
    text = F.col("_row").getField(text_col)
    cut = mine.withColumn("_cut", F.udf(_without, "text string, gone array<int>", useArrow=True)(F.when(F.col("_runs").isNotNull(), text.cast("string")), F.col("_runs")))
    new = F.when(F.col("_runs").isNull(), text).otherwise(F.col("_cut.text"))
    cols = [new.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names]
    return cut.select(*cols, F.coalesce("_cut.gone", F.array().cast("array<int>")).alias("dropped_lines"))
