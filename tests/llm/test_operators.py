"""Small fixtures: nulls, empty and repeated rows, ties, other columns; results held against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tracewell.llm import arc_warc, exact_dedup, license_scan, line_dedup, mixing, order_minhash, packing, quality_rules

COLS = "doc_id long, text string, lang string, source string, id long"
LONG = "alpha beta gamma delta epsilon zeta eta theta"
ROWS = [
    (1, "same text here", "en", "a", 9), (2, "same text here", "en", "b", 9), (2, "same text here", "en", "b", 9), (3, None, None, None, 9), (4, "", "en", "a", 9),
    (None, "no identifier", "en", "c", 9), (5, f"{LONG}\nx y\nown line of five words", "en", "a", 9), (6, f"other start\n{LONG}\nx y\nend", "en", "b", 9),
    (7, "Licensed under the Apache License, Version 2.0. MIT License", "en", "c", 9), (8, "word " * 5000, "en", "a", 9),
]


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLS)


def test_exact(docs, empty):
    got = exact_dedup.exact_groups(docs, keep="max").collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({t or "" for _, t, *_ in ROWS})
    same = [r for r in got if r.id in (1, 2)]
    assert {(r.keep_id, r.group_size) for r in same} == {(2, 3)} and sum(r.kept for r in same) == 1
    assert {r.digest for r in same} == {hashlib.sha256(b"same text here").hexdigest()}
    assert {r.keep_id for r in exact_dedup.exact_groups(docs).collect() if r.id in (1, 2)} == {1}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_lines(docs, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[5].dropped_lines == [] and got[6].dropped_lines == [1, 2] and got[6].text == "other start\nend"
    assert got[3].text is None and got[1].text == "same text here"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    texts = ["\n".join(r.choice(["a", "b b", "c c c", "d", "e e e e e e"]) for _ in range(r.randrange(1, 9))) for _ in range(30)]
    at: dict = {}
    want = {}
    for d, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if at.setdefault(run, (d, i)) < (d, i) and sum(len(x.split()) for x in run) >= 5:
                    gone |= set(range(i, j))
        want[d] = sorted(gone)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.dropped_lines for r in line_dedup.dedup_lines(df).collect()} == want


def test_near(docs, empty, spark):
    got = order_minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {r.class_id for r in got if r.id in (1, 2)} == {1}
    r = random.Random(1)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = w[:50] + ["new"] + w[51:]
    far = [f"v{r.randrange(10**6)}" for _ in range(200)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.id: (r.class_id, r.n_links) for r in order_minhash.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert order_minhash.near_duplicates(empty).count() == 0


def test_alignment():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = np.random.default_rng(2)
    for _ in range(150):
        a, b = (r.integers(0, 4, r.integers(0, 20)).astype(np.uint64) for _ in range(2))
        most = int(r.integers(0, 15))
        d = distance(a.tolist(), b.tolist())
        assert order_minhash.aligned_distance(a, b, most) == (d if d <= most else None)


def test_license(docs, empty):
    got = {r.id: r for r in license_scan.scan(docs).collect()}
    assert (got[7].n_base, got[7].first_word, got[7].last_word, got[7].base_labels) == (2, 3, 8, "apache,mit")
    assert got[3].n_words == 0 and got[3].labels == "" and got[3].first_word is None
    assert license_scan.scan(empty).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    assert sum(r.size for r in got) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    bins = Counter()
    for r in got:
        if r.bin_id is not None:
            bins[r.bin_id] += r.size
            assert r.bin_offset + r.size <= r.bin_used <= r.bin_length
    assert all(bins[r.bin_id] == r.bin_used for r in got if r.bin_id is not None)
    assert packing.pack(empty).count() == 0


def test_archives(spark):
    rows = [(1, "http://a b/", "x"), (2, None, "x"), (3, "u", None), (None, "u", "é\n\n"), (2, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    got = arc_warc.round_trip(pages).collect()
    assert Counter((r.key, r.warc_type, r.length, r.refers_to) for r in got) == Counter({("1", "response", 1, None): 1, ("2", "revisit", 1, "1"): 2, ("3", "response", 0, None): 1, (None, "response", 4, None): 1})
    assert all(r.computed in (None, r.declared) for r in got)
    assert arc_warc.round_trip(pages.limit(0)).count() == 0


def test_rules(docs, empty, spark):
    def brute(text):
        w = (text or "").split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len(w), len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})

    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    assert sorted((r.n_words, r.n_repeat_words) for r in got) == sorted(brute(t) for _, t, *_ in ROWS)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10)


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken == r.copies * r["size"] and r.copies <= 3 for r in got)
    assert mixing.mix(empty).count() == 0
