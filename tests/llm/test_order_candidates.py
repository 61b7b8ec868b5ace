"""Candidates of Order MinHash against all pairs that share an element."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tracewell.llm import order_minhash


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_one_common_element_is_enough(spark):
    rng = random.Random(3)
    # Few enough share an element that every bucket is small.
    rows = [(bytes([k] * 16), [rng.randrange(12) if j < 2 else 1000 * k + j for j in range(order_minhash.ELEMENTS)]) for k in range(30)]
    share = lambda x, y: any(p == q for p, q in zip(x, y, strict=True))
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if share(x, y)}
    assert max(sum(r[1][j] == e for r in rows) for j in (0, 1) for e in range(12)) <= order_minhash.SMALL
    got = order_minhash.candidates(spark.createDataFrame(rows, "node binary, e array<bigint>")).collect()
    assert len(got) == len(want) and {(bytes(r.a), bytes(r.b)) for r in got} == want


def test_large_buckets_give_the_classes_of_all_their_pairs(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, texts = [word() for _ in range(70)], []
    for _ in range(110):
        # Beside the passage, variants of a tail have no shingle in common.
        tail = [word() for _ in range(30)]
        texts += [passage + [word() if k % 3 == v else w for k, w in enumerate(tail)] for v in range(3)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    hashes = [order_minhash.word_hashes(t) for _, t in rows]
    sketches = [order_minhash.sketch(w) for w in hashes]
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    sizes, lost = Counter((j, e) for s in sketches for j, e in enumerate(s.tolist())), 0
    for x, y in itertools.combinations(range(len(rows)), 2):
        at = np.flatnonzero(sketches[x][: order_minhash.ELEMENTS] == sketches[y][: order_minhash.ELEMENTS])
        if len(at) and order_minhash.similar(hashes[x], hashes[y]) is not None:
            lost += all(sizes[j, sketches[x][j]] > order_minhash.SMALL for j in at.tolist())
            own[max(root(x), root(y))] = min(root(x), root(y))
    assert max(sizes.values()) > order_minhash.BLOCK and lost
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in got} == {k: root(k) for k in range(len(rows))}


def test_search_of_large_buckets_names_only_similar_pairs_once(spark):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(70)]
    texts = [passage + [f"w{rng.randrange(10**9)}" for _ in range(30)] for _ in range(300)]
    texts += [t[:-15] + [f"v{rng.randrange(10**9)}" for _ in range(15)] for t in texts[:5]]
    hashes = [order_minhash.word_hashes(" ".join(t)) for t in texts]
    nodes = [bytes([k // 256, k % 256]) for k in range(len(texts))]
    # Every node is in three large buckets, and in one with those of its own class alone.
    met = spark.createDataFrame([(q, n, len(nodes)) for q in range(3) for n in nodes] + [(9, n, 100) for n in nodes[:100]], "k long, node binary, n long")
    classes = spark.createDataFrame([(n, nodes[0]) for n in nodes[:100]], "node binary, class binary")
    rows = [(n, len(w), (w >> np.uint64(32)).astype(np.uint32).tobytes()) for n, w in zip(nodes, hashes, strict=True)]
    got = order_minhash.across(met, classes, spark.createDataFrame(rows, "node binary, words int, w binary")).collect()
    apart = lambda x, y: y >= 100
    want = {(nodes[x], nodes[y]) for x, y in itertools.combinations(range(len(nodes)), 2) if apart(x, y) and order_minhash.similar(hashes[x], hashes[y]) is not None}
    assert len(want) >= 5 and len(nodes) > order_minhash.BLOCK
    assert len(got) == len(want) and {(bytes(r.a), bytes(r.b)) for r in got} == want


def test_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from tracewell.llm import common

    held, own = [], spark.conf.get(common.CLEANUP, None)
    out = common.written(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        held = [f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f]
        if not held:
            break
        time.sleep(0.1)
    assert not held and out.count() == 7 and spark.conf.get(common.CLEANUP, None) == own


def test_alignment_by_columns():
    rng = np.random.default_rng(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(2, 12), rng.integers(1, 80)).astype(np.uint64) for _ in range(2))
        most, d = int(rng.integers(0, 80)), distance(a.tolist(), b.tolist())
        assert order_minhash._columns(a, b, most) == (d if d <= most else None)


@pytest.mark.parametrize("n", [9, 50, 3500])
def test_chain_links_a_whole_bucket(spark, n):
    rng = random.Random(n)
    names = sorted(rng.randbytes(16) for _ in range(n))
    met = spark.createDataFrame([(1, x, n, names[0]) for x in names], "k long, node binary, n long, first binary")
    got = {(bytes(r.a), bytes(r.b)) for r in order_minhash._chained(met).collect()}
    assert got == set(itertools.pairwise(names)) | {(names[0], x) for x in names[1:]}


def _edited(rng, w, n, kinds):
    w = list(w)
    for _ in range(n):
        at, kind = rng.randrange(len(w)), rng.choice(kinds)
        w[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.randrange(1 << 60)]
    return np.array(w, np.uint64)


def _met(a, b):
    x, y = order_minhash.sketch(a), order_minhash.sketch(b)
    n = order_minhash.ELEMENTS
    return bool((x[:n] == y[:n]).any() or np.intersect1d(x[n:], y[n:]).size)


def recall(edits, pairs=300, words=150):
    """Share of pairs of the similarity that substitutions leave at random places which share an element."""
    rng = random.Random(edits)
    found = 0
    for _ in range(pairs):
        a = np.array([rng.randrange(1 << 60) for _ in range(words)], np.uint64)
        b = a.copy()
        b[rng.sample(range(words), edits)] = [rng.randrange(1 << 60) for _ in range(edits)]
        found += _met(a, b)
    return found / pairs


@pytest.mark.parametrize("edits", [30, 27, 22, 15])
def test_similar_texts_share_an_element(edits):
    assert recall(edits) > 0.97


def test_short_similar_texts_always_share_an_element():
    rng = random.Random(8)
    seen = 0
    for _ in range(3000):
        a = np.array([rng.randrange(1 << 60) for _ in range(rng.randrange(1, 15))], np.uint64)
        b = _edited(rng, a, rng.randrange(3), ("insert", "delete", "replace")) if len(a) > 3 else a
        if len(b) <= 14 and order_minhash.similar(a, b) is not None:
            seen += 1
            assert _met(a, b)
    assert seen > 500
