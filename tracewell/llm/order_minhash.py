"""Near-duplicate detection by Order MinHash.

A text's k-mers are shingles of five words, each labelled with its occurrence number. For every hash function the
few k-mers with the smallest hashes, put back into text order, are one element of the sketch, so that elements agree
with a probability that follows edit similarity. Short texts have further elements: similar ones share one always. Equal
contents are one node. Nodes that share an element are candidates: small buckets give all their pairs. In some of the larger
ones it is in, each node is linked to the bucket's first node and to the next one in order. Then the pairs of large buckets that these
links left in different classes are searched without loss, each in the first bucket that has both: lengths, counts of words and of
pairs of words, and alignment of short hashes rule out those that no edits allowed can make alike; banded alignment of the words
verifies the others. Classes are the connected components of the verified links, as if every pair of every bucket were aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.scans import join_groups

from .common import discard, written

#: Words in a shingle, shingles in an element, elements in a sketch, least edit similarity.
K, ELL, ELEMENTS, SIMILAR = 5, 2, 96, 0.8
#: Words of texts whose similar pairs are all found: their sketches also hold what they are without the edits allowed.
SHORT = 14
#: Nodes in a bucket that gives all its pairs; larger buckets in which a node is linked before they are searched.
SMALL, LINKED = 8, 3
#: Nodes in a range of a large bucket's chain.
RANGE = 1000
#: Nodes in a bucket that is one block; counters of a text's words; edits that are looked for diagonal by diagonal.
BLOCK, BINS, FEW = 256, 128, 12

_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_SEEDS = np.random.default_rng(20200).integers(1, 1 << 63, (2, ELEMENTS), np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) <= n:
        size = max(n + 1, 2 * len(_UP))
        with np.errstate(over="ignore"):
            _UP, _DOWN = (np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            _UP[0] = _DOWN[0] = 1
            _UP, _DOWN = np.cumprod(_UP, dtype=np.uint64), np.cumprod(_DOWN, dtype=np.uint64)
    return _UP, _DOWN


_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)
#: A table for bytes: letters and digits as they are, other ASCII as 0, which parts words.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 0 for b in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word: a run of letters and digits (all of UTF-8 beyond ASCII counts), in lower case."""
    raw = (text or "").lower().encode("utf-8", "replace").translate(_TABLE)
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = b != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.astype(np.uint64) * up[: len(b)], dtype=np.uint64)])
        return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(w: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled hashes of the shingles; fewer than k words are one shingle."""
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * np.uint64(_BASE) + w[j : j + n]
        s = _mix(s)
        order = np.argsort(s, kind="stable")
        t = s[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        at = np.arange(n)
        label = at - np.maximum.accumulate(np.where(new, at, 0))
        # First occurrences get their label too: they must agree with those of texts that repeat nothing.
        s[order] = _mix(t + label.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return s


def sketch(w: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """ELEMENTS hashes, each of ELL shingles with the smallest hashes in text order, then those of without(); empty without words."""
    s = shingles(w)
    if not len(s):
        return s
    with np.errstate(over="ignore"):
        h = s[None, :] * _SEEDS[0][:, None] + _SEEDS[1][:, None]
        h ^= h >> np.uint64(32)
        rows = np.arange(ELEMENTS)
        picked = []
        for j in range(min(ELL, len(s))):
            at = h.argmin(1)
            picked.append(at)
            if j + 1 < min(ELL, len(s)):
                h[rows, at] = _M
        order = np.sort(np.stack(picked, 1), 1)
        e = np.arange(1, ELEMENTS + 1).astype(np.uint64)
        for j in range(order.shape[1]):
            e = _mix(e * np.uint64(_BASE) + s[order[:, j]])
        return np.concatenate([e, without(w, least)])


def without(w: np.ndarray, least: float) -> np.ndarray:
    """Hashes of a text of SHORT words or fewer without any of its words, as many as may be edited; none for longer texts.

    Texts that few edits part are equal without the words edited, so similar ones share a hash.
    """
    if len(w) > SHORT:
        return w[:0]
    # Against a longer text fewer of these are needed, as edits also make up for its length.
    most = int(len(w) * (1 - least) + 1e-9)
    out = []
    with np.errstate(over="ignore"):
        for gone in range(most + 1):
            left = np.array(list(combinations(range(len(w)), len(w) - gone)))
            h = np.full(len(left), len(w) - gone, np.uint64)
            for j in range(left.shape[1]):
                h = _mix(h * np.uint64(_BASE) + w[left[:, j]])
            out.append(h)
    return np.unique(np.concatenate(out))


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two texts share, counted as often as both have them."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def aligned_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two word sequences if it is most or less, else None.

    Only diagonals of a band are filled that edits up to most can reach; the ends that are equal are left out.
    """
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    k = n if same.all() else int(same.argmin())
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        k = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - k], b[: len(b) - k]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= most else None
    d = _furthest(a, b, min(most, FEW))
    return d if d is not None or most <= FEW else _columns(a, b, most)


def _columns(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance if it is most or less, by columns of the alignment, each two numbers of a bit for each word of a.

    Faster than _furthest() unless edits are few.
    """
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full, last, d = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for left, w in enumerate(b.tolist(), 1 - len(b)):
        same = at.get(w, 0)
        x = ((same & up) + up ^ up) | same | down
        more, less = down | full & ~(x | up), up & x
        d += 1 if more & last else -1 if less & last else 0
        # Each further column takes away one at most.
        if d + left > most:
            return None
        more, less = (more << 1 | 1) & full, less << 1 & full
        same |= down
        up, down = less | full & ~(same | more), more & same
    return d if d <= most else None


def _furthest(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance if it is most or less: for every number of edits, how far each diagonal of the band gets.

    The band is as wide as the edits so far allow, so near copies cost little more than their length. A
    diagonal's mismatches are found once, when it is first reached.
    """
    n, m = len(a), len(b)
    goal = m - n
    stops: dict[int, np.ndarray] = {}
    before: dict[int, int] = {}
    for e in range(most + 1):
        now: dict[int, int] = {}
        slack = most - e
        for k in range(max(-e, -n, goal - slack), min(e, m, goal + slack) + 1):
            if e:
                i = max(before.get(k, -2) + 1, before.get(k - 1, -2), before.get(k + 1, -2) + 1)
                if i < 0:
                    continue
            else:
                i = 0
            end = min(n, m - k)
            i = min(max(i, -k), end)
            at = stops.get(k)
            if at is None:
                low = max(0, -k)
                at = stops[k] = np.append(np.flatnonzero(a[low:end] != b[low + k : end + k]) + low, end)
            i = int(at[at.searchsorted(i)])
            now[k] = i
            if k == goal and i >= n:
                return e
        before = now
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float | None:
    """1 - edit distance / length of the longer text if that is least or more."""
    top = max(len(a), len(b))
    if not len(a) or not len(b):
        return None
    most = int(top * (1 - least) + 1e-9)
    if top - min(len(a), len(b)) > most or top - common_words(a, b) > most:
        return None
    # An edit breaks two pairs of neighbours at most.
    with np.errstate(over="ignore"):
        pairs = [x[:-1] * np.uint64(_BASE) + x[1:] for x in (a, b)]
    if top - 1 - common_words(*pairs) > 2 * most:
        return None
    d = aligned_distance(a, b, most)
    return None if d is None else 1 - d / top


def word_counts(w: np.ndarray) -> np.ndarray:
    """How many words fall into each of BINS counters, 255 at most."""
    return np.minimum(np.bincount((_mix(w) >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8)


def neighbours(w: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    with np.errstate(over="ignore"):
        return _mix(w[:-1] * np.uint64(_BASE) + w[1:])


def _sketches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [word_hashes(t) for t in batch.column("text").to_pylist()]
            out = [sketch(w, least).view(np.int64) for w in hashes]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            values = np.concatenate(out) if out else np.empty(0, np.int64)
            e = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, pa.int64()))
            n = pa.array([len(w) for w in hashes], pa.int32())
            own = pa.array([(w >> np.uint64(32)).astype(np.uint32).tobytes() for w in hashes], pa.binary())
            yield pa.record_batch({"id": batch.column("id"), "node": batch.column("node"), "e": e, "words": n, "w": own})

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[], [], []]
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                s = similar(_widened(x), _widened(y), least)
                if s is not None:
                    for col, value in zip(kept, (a, b, s), strict=True):
                        col.append(value)
            yield pa.record_batch({"a": pa.array(kept[0], pa.binary()), "b": pa.array(kept[1], pa.binary()), "similarity": pa.array(kept[2], pa.float64())})

    return run


def _widened(raw: bytes) -> np.ndarray:
    """Word hashes of 32 bits, as they are stored, as numbers of 64."""
    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def buckets(nodes: DataFrame) -> DataFrame:
    """nodes: node, e (sketch) -> k, node, j, n (nodes in the bucket), first (the smallest), for buckets of two nodes or more."""
    keys = nodes.select("node", F.posexplode("e").alias("j", "k")).select("node", F.least("j", F.lit(ELEMENTS)).alias("j"), "k").select("node", "j", F.xxhash64("j", "k").alias("k"))
    sizes = written(keys.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "omh-sizes")
    return written(join_groups(keys, sizes, ["k"], sizes.agg(F.sum("n")).first()[0] or 0, "n", ["node"]), "omh-buckets")


def candidates(nodes: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """nodes: node, e (sketch) -> a, b: pairs of nodes, a < b, without repeats: all of small buckets, some of large ones.

    Of the large buckets that it is in, a node is linked in LINKED, those with the smallest keys, so that similar nodes choose alike.
    """
    met = buckets(nodes) if met is None else met
    choice = F.row_number().over(Window.partitionBy("node").orderBy("k"))
    chosen = met.where(F.col("n") > SMALL).withColumn("choice", choice).where(F.col("choice") <= LINKED).drop("choice")
    return _all_pairs(met.where(F.col("n") <= SMALL)).unionByName(_chained(written(chosen, "omh-chosen"))).distinct()


def _all_pairs(met: DataFrame) -> DataFrame:
    """Of buckets with SMALL nodes or fewer."""
    grouped = met.groupBy("k").agg(F.sort_array(F.collect_set("node")).alias("g")).select("g").distinct()
    left = grouped.select("g", F.posexplode("g").alias("p", "a"))
    return left.select("a", F.explode(F.slice("g", F.col("p") + 2, F.size("g"))).alias("b"))


def _chained(met: DataFrame) -> DataFrame:
    """Each node of a large bucket with the bucket's first node, and with the next one in the order of nodes."""
    star = met.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    # The order runs within ranges of about RANGE nodes, so that no task needs all of a bucket; then the ranges' ends are linked.
    start = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long")
    parts = met.select("k", "node", F.floor(start * F.ceil(F.col("n") / RANGE) / F.lit(1 << 32)).alias("part"))
    near = Window.partitionBy("k", "part").orderBy("node")
    within = parts.select(F.col("node").alias("a"), F.lead("node").over(near).alias("b"))
    ends = parts.groupBy("k", "part").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    between = ends.select(F.col("high").alias("a"), F.lead("low").over(Window.partitionBy("k").orderBy("part")).alias("b"))
    return star.unionByName(within.unionByName(between).where("b IS NOT NULL AND a <> b"))


def across(met: DataFrame, classes: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """met: buckets; classes: node, class; texts: node, words, w -> a, b: pairs of nodes of large buckets, a < b, without repeats.

    Every pair of nodes in different classes that share a large bucket and may be similar, as far as short hashes of their words tell.
    Buckets of one class are left out. Others are dealt out to pairs of blocks, so that no task needs all of a bucket; the number of
    blocks and their size both grow with the root of the bucket's.
    """
    large = met.where(F.col("n") > SMALL).select("k", "node", "n").join(classes, "node", "left")
    large = written(large.select("k", "node", "n", F.coalesce("class", "node").alias("class")), "omh-large")
    mixed = written(large.groupBy("k").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("k", "n"), "omh-mixed")
    rows = written(join_groups(large.drop("n"), mixed, ["k"], _total(mixed, "n"), "n", ["node"]), "omh-meet")
    own = rows.groupBy("node", "class").agg(F.sort_array(F.collect_list("k")).alias("ks")).join(texts, "node")
    own = own.select("node", "class", "ks", "w").mapInArrow(_shortened, "node binary, class binary, ks array<bigint>, s binary")
    blocks = F.ceil(F.sqrt(F.col("n") / BLOCK)).cast("long")
    dealt = rows.drop("class").join(own, "node").withColumn("p", F.pmod(F.xxhash64("node"), blocks)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    # Of a node's buckets those before this one tell which pairs were met already.
    item = F.struct("node", "class", "s", F.filter("ks", lambda x: x < F.col("k")).alias("ks"), "p")
    dealt = dealt.groupBy("k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(F.collect_list(item).alias("g"))
    return dealt.select("i", "j", "g").mapInArrow(_allowed(least), "a binary, b binary")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as 16 bits each: this may make texts more alike, never less."""
    for batch in batches:
        short = [(np.frombuffer(raw, np.uint32) >> np.uint32(16)).astype(np.uint16).tobytes() for raw in batch.column("w").to_pylist()]
        yield pa.record_batch({"node": batch.column("node"), "class": batch.column("class"), "ks": batch.column("ks"), "s": pa.array(short, pa.binary())})


def _met_before(keys: list[list[int]]) -> np.ndarray:
    """A row for each node, a column for each key that two or more have: 1 where it has it."""
    lens = [len(x) for x in keys]
    every, of, n = np.unique(np.fromiter((k for x in keys for k in x), np.int64, sum(lens)), return_inverse=True, return_counts=True)
    out = np.zeros((len(keys), len(every)), np.float32)
    out[np.repeat(np.arange(len(keys)), lens), of] = 1
    return out[:, n > 1]


def _allowed(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, g in zip(*(batch.column(c) for c in ("i", "j", "g")), strict=True):
                x = g.values
                name = x.field("node").to_pylist()
                _, of = np.unique(np.array([c.hex() for c in x.field("class").to_pylist()]), return_inverse=True)
                if of.max() == 0:
                    continue
                block = x.field("p").to_numpy(zero_copy_only=False)
                w = [np.frombuffer(raw, np.uint16).astype(np.uint64) for raw in x.field("s").to_pylist()]
                words = np.array([len(v) for v in w], np.int64)
                counts = np.stack([word_counts(v) for v in w]).astype(np.int16)
                pairs = np.stack([word_counts(neighbours(v)) for v in w]).astype(np.int16)
                before = _met_before(x.field("ks").to_pylist())
                left, right = np.flatnonzero(block == i.as_py()), np.flatnonzero(block == j.as_py())
                a, b = [], []
                for k, at in enumerate(left):
                    if k % 256 == 0:
                        again = before[left[k : k + 256]] @ before[right].T > 0
                    to = right[~again[k % 256] & (of[right] != of[at])]
                    if i.as_py() == j.as_py():
                        to = to[to > at]
                    top = np.maximum(words[to], words[at])
                    most = (top * (1 - least) + 1e-9).astype(np.int64)
                    more = np.abs(words[to] - words[at])
                    ok = most >= more
                    to, most, more = to[ok], most[ok], more[ok]
                    # An edit changes counts and length together by two at most, those of pairs by four.
                    ok = np.abs(counts[to] - counts[at]).sum(1) <= 2 * most - more
                    to, most, more = to[ok], most[ok], more[ok]
                    for b_at in to[np.abs(pairs[to] - pairs[at]).sum(1) <= 4 * most - more]:
                        if similar(w[at], w[b_at], least) is not None:
                            low, high = sorted((name[at], name[b_at]))
                            a.append(low)
                            b.append(high)
                yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b -> node, class (the smallest node that is linked with it), for all nodes of edges.

    Every round, nodes point to their smallest neighbour and follow the pointers, in doubling steps, to one that points to
    itself; the graph is contracted to these, so each round leaves at most half of the nodes that have links. Only counts go
    to the driver.
    """
    left = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(left.groupBy(F.col("a").alias("node")).agg(F.first("a").alias("class")), "labels")
    while True:
        if not left.limit(1).count():
            # Labels are smallest nodes of their parts already, as each step goes to a smaller neighbour.
            return labels
        near = written(left.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "labels")
        step, moving = near, True
        while moving:
            over = step.select(F.col("a").alias("to"), F.col("to").alias("top"))
            nxt = written(step.join(over, "to").select("a", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")), "labels")
            step, moving = nxt.drop("moved"), nxt.where("moved").limit(1).count() > 0
        of = lambda name: step.select(F.col("a").alias(name), F.col("to").alias(f"{name}2"))  # noqa: B023, E731
        labels = written(labels.join(of("class"), "class", "left").select("node", F.coalesce("class2", "class").alias("class")), "labels")
        moved = left.join(of("a"), "a").join(of("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        left = written(moved.distinct(), "links")


def _links(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """texts: node, words, w; pairs: a, b -> those that alignment verifies: a, b, similarity. A node with many partners is dealt out."""
    total = pairs.count()
    for end, words in (("a", "x"), ("b", "y")):
        partners = pairs.groupBy(end).agg(F.count("*").alias("n"))
        own = partners.join(texts.select(F.col("node").alias(end), F.col("w").alias(words)), end)
        pairs = join_groups(pairs, own, [end], total, "n", ["a", "b"]).drop("n")
    return written(pairs.select("a", "b", "x", "y").mapInArrow(_verify(least), "a binary, b binary, similarity double"), "omh-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per row of docs: id, node (MD5 of the text), class_id, class_size, n_links, kept.

    class_id is the smallest identifier of the texts linked with it, over copies and verified links; n_links
    counts the different texts that a text was verified against; in buckets of over SMALL texts not all pairs within a
    class are. kept is true for one row of each class: the smallest
    identifier's. Texts without words are equal to nothing but exact copies of themselves. Null texts count as empty,
    null identifiers as larger than any other, and of rows equal in identifier and text one is kept. An empty table gives an
    empty result; columns beside the two named ones are ignored.
    """
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(t)).alias("node"), t.alias("text"))
    sketches = written(base.mapInArrow(_sketches(least), "id long, node binary, e array<bigint>, words int, w binary").withColumn("at", F.monotonically_increasing_id()), "omh-sketches")
    rows = written(sketches.select("id", "node", "at"), "omh-rows")
    # A node's sketch and words are read from the row that stands for it, and its short name tells it apart.
    stands = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    nodes = written(rows.groupBy("node").agg(stands.alias("m"), F.count("*").alias("copies")).select(F.col("node").alias("whole"), _short(F.col("m.at")).alias("node"), "m.none", "m.id", "m.at", "copies"), "omh-nodes")
    standing = sketches.where("words > 0").drop("node").join(nodes.select("at", "node"), "at")
    searched = written(standing.select("node", "e"), "omh-searched")
    met = buckets(searched)
    texts = written(standing.join(met.select("node").distinct(), "node", "left_semi").select("node", "words", "w"), "omh-texts")
    discard(sketches, searched)
    pairs = written(candidates(searched, met), "omh-pairs")
    links = _links(texts, pairs, least)
    classes = components(links)
    if met.where(F.col("n") > SMALL).limit(1).count():
        more = written(across(met, classes, texts, least).join(pairs, ["a", "b"], "left_anti"), "omh-pairs")
        if more.limit(1).count():
            links = links.unionByName(_links(texts, more, least))
            classes = components(links)
    discard(met, texts)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    member = written(nodes.join(classes, "node", "left").join(degree, "node", "left").withColumn("class", F.coalesce("class", "node")), "omh-members")
    tops = member.groupBy("class").agg(F.min(F.struct("none", "id", "node")).alias("m"), F.sum("copies").alias("class_size"))
    # A class may hold a third of all nodes, a node a third of all rows.
    sized = member.groupBy("class").agg(F.count("*").alias("members")).join(tops, "class")
    per_node = join_groups(member, sized, ["class"], _total(nodes, "1"), "members", ["node"])
    per_node = written(per_node.select(F.col("whole").alias("node"), "at", "copies", F.col("m.id").alias("class_id"), (F.col("m.node") == F.col("node")).alias("top"), "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "omh-classes")
    out = join_groups(rows.select("id", "node", F.col("at").alias("row")), per_node, ["node"], _total(nodes, "copies"), "copies", ["row"])
    return out.select("id", "node", "class_id", "class_size", "n_links", (F.col("top") & (F.col("row") == F.col("at"))).alias("kept"))


def _short(at: Column) -> Column:
    """Eight bytes that are a row's number, the other way round, so that they are spread over their whole range."""
    return F.unhex(F.reverse(F.lpad(F.hex(at), 16, "0")))


def _total(df: DataFrame, what: str) -> int:
    return df.agg(F.expr(f"sum({what})")).first()[0] or 0


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs, with all columns whatever their names, with one row of each class of near-duplicates; texts without words all stay but for copies.

    Of rows that are equal in identifier and text one stays, whichever; see near_duplicates() for nulls and ties.
    """
    found = near_duplicates(docs, id_col, text_col, least).where("kept").select("id", "node")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    mine = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("_id"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias("_node"))
    out = mine.join(found, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    return out.dropDuplicates(["_id", "_node"]).select("_row.*")
