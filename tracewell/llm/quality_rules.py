"""Quality rules with risk-controlled thresholds.

Counts of a text give rules such as symbols a word. For each rule and length stratum, labelled documents that the
base rules keep are a holdout: a histogram of the good and the bad ones by the rule's value. A cutoff is allowed if
an exact binomial test shows, with all tests' errors added up (Bonferroni), that it rejects at most ALPHA of the
good documents in its stratum. Of the allowed ones, that with the best balance of bad to good rejections is used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, words, written

SYMBOLS = "#*$%&|<>"
#: Word counts that part the strata.
STRATA = (100, 300, 1000)
#: Rules: a value per text that grows with junk, and the width of a histogram bucket. There are BUCKETS of them.
RULES = {
    "symbols": ("n_symbols / n_words", 0.05),
    "repeats": ("n_repeat_words / n_words", 0.02),
    "dup_lines": ("n_dup_lines / n_lines", 0.02),
    "long_words": ("word_chars / n_words", 0.5),
    "short_words": ("n_words / word_chars", 0.02),
}
BUCKETS = 64
#: At most this share of good documents is rejected falsely in a stratum, over all rules, with probability 1 - DELTA.
ALPHA, DELTA = 0.05, 0.05
#: A good document rejected weighs as much as so many bad ones.
GOOD_WEIGHT = 20


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more, from an array of words.

    Windows are compared by 64-bit hash. A window's places are sorted by it, so equal ones are neighbours: no
    text costs more than n log n.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, windows).otherwise(F.array().cast("array<bigint>"))


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) put on as struct m."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    a = docs.select("*", words(F.col(text_col)).alias("_w"), lines.alias("_l"))
    b = a.select("*", _repeat_words(F.col("_w")).alias("_h"))
    places = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), places).alias("_s"))
    s = F.col("_s")
    same = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
    d = c.select("*", F.sort_array(F.array_compact(same)).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1), x + 3) - x)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    m = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return d.withColumn("m", m).drop("_w", "_l", "_h", "_s", "_p")


def base_failed() -> Column:
    """Of columns n_words and n_repeat_words."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(rule: str) -> Column:
    value, width = RULES[rule]
    top, under = value.split(" / ")
    x = F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))
    return F.least(F.lit(BUCKETS - 1), F.floor(x / F.lit(width))).cast("int")


def _stratum() -> Column:
    out = F.lit(len(STRATA))
    for k, limit in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < limit, k).otherwise(out)
    return out


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x), the exact test's p-value for 'the rate is p or more'."""
    if x >= n:
        return 1.0
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    if x >= n * p:
        return 1.0  # never small; needs no sum
    total, k, term = 0.0, x, math.exp(log(x))
    while k >= 0 and term > 1e-18 * max(total, 1e-300):  # terms fall from x downwards, as x is below the mean
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return min(1.0, total)


def choose_cutoffs(histogram: list[tuple[int, str, int, int, int]], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], int]:
    """(stratum, rule, bucket, good, bad) -> (stratum, rule) -> largest bucket that is kept. Pairs without an allowed useful cutoff are left out."""
    counts: dict = {}
    for stratum, rule, bucket, good, bad in histogram:
        counts.setdefault((stratum, rule), {})[bucket] = (good, bad)
    each, level = alpha / len(RULES), delta / ((len(STRATA) + 1) * len(RULES) * (BUCKETS - 1))
    out = {}
    for key, by in counts.items():
        n = sum(g for g, _ in by.values())
        best = None
        good = bad = 0
        for cut in range(BUCKETS - 2, -1, -1):  # from the cutoff that rejects least
            g, b = by.get(cut + 1, (0, 0))
            good, bad = good + g, bad + b
            if binomial_tail(good, n, each) > level:
                break  # further cutoffs reject more
            gain = bad - GOOD_WEIGHT * good
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, cut)
        if best:
            out[key] = best[1]
    return out


def rejection(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> Column:
    """A condition on the metrics' columns, from rows (id, metrics, base_failed, stratum) and labels (doc_id, quality)."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    held = rows.where("NOT base_failed").join(marks, "id")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _bucket(r).alias("bucket")) for r in RULES)))
    found = held.select("stratum", "quality", pairs.alias("x")).groupBy("stratum", "x.rule", "x.bucket").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    # At most strata x rules x buckets rows.
    cutoffs = choose_cutoffs([tuple(r) for r in found.collect()], alpha, delta)
    out = F.lit(False)
    for (stratum, rule), cut in sorted(cutoffs.items()):
        out = out | ((_stratum() == stratum) & (_bucket(rule) > cut))
    return out


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = metrics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "m.*")
    return written(rows, "quality-metrics").withColumn("base_failed", base_failed()).withColumn("stratum", _stratum())


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: id, the metrics, base_failed, kept.

    labels (doc_id, quality) mark good documents; of repeated labels the lowest counts, null ones don't. Null and
    empty texts have no words, so the base rules reject them. With few or no labels no cutoff can be shown to be
    safe, and only the base rules reject. Columns beside the named ones are ignored; empty tables give empty results.
    """
    rows = _measured(docs, id_col, text_col)
    rejected = rejection(rows, labels, alpha, delta)
    return rows.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum")


def judge_kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts are measured twice, but never shuffled."""
    rejected = rejection(_measured(docs, id_col, text_col), labels, alpha, delta)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("text"))
    # A filter is pushed below a projection and there repeats its expressions, unless that has a column that isn't
    # deterministic: each text is to be measured once.
    measured = metrics(own).select("_row", "m.*", F.monotonically_increasing_id().alias("_at"))
    return measured.where((F.col("_at") >= 0) & ~base_failed() & ~rejected).select("_row.*")
