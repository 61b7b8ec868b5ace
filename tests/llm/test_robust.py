"""Clashing names, very long texts, large and repeated identifiers, damaged archives, and whole queries against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import arc_warc, exact_dedup, license_scan, line_dedup, mixing, order_minhash, packing, quality_mil, quality_rules, toxicity

CLASH = ["_id", "_node", "_n", "_d", "_key", "_no", "_row", "_w", "_h", "_l", "_at", "m", "id", "n", "key", "dropped_lines", "kept"]


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="module")
def clashing(spark):
    text = "one two three four five six\nseven eight nine ten eleven twelve"
    rows = [(k, t, "en", "s", len(t or ""), *(f"{c}{k}" for c in CLASH)) for k, t in enumerate([text, text, "other\n" + text, None, ""])]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in CLASH)]))


def test_names_of_other_columns_do_not_matter(clashing, spark):
    cols = clashing.columns
    for f in (exact_dedup.drop_copies, order_minhash.drop_near_duplicates, mixing.mixed):
        out = f(clashing)
        assert out.columns == cols
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASH)
    out = line_dedup.dedup_lines(clashing)
    assert sorted(out.columns) == sorted(cols)
    assert {r.doc_id: r.dropped_lines for r in out.collect()} == {0: [], 1: [0, 1], 2: [1, 2], 3: [], 4: []}
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASH if c != "dropped_lines")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_rules.judge_kept(clashing, labels).columns == cols
    for f in (exact_dedup.exact_groups, order_minhash.near_duplicates, mixing.mix, packing.pack, license_scan.scan):
        assert f(clashing).count() == 5
    assert quality_rules.judge(clashing, labels).count() == 5


def test_texts_without_spaces_take_linear_time():
    for text in ("a" * 1_000_000, "a.b$1" * 200_000, "a\n" * 300_000):
        began = time.time()
        groups = [frozenset(["bad"])]
        toxicity.votes_of(*toxicity.words_of(text), groups, groups[0])
        quality_mil.passages(text)
        order_minhash.sketch(order_minhash.word_hashes(text[:200_000]))
        assert time.time() - began < 60


def test_passages_of_a_long_text_are_those_of_its_parts():
    r = random.Random(4)
    words = ["w" * r.randrange(1, 12) + r.choice(["", "é", "!", "#"]) for _ in range(64 * 3000)]
    whole = quality_mil.passages(" ".join(words))
    parts = np.concatenate([quality_mil.passages(" ".join(words[k : k + 6400]) + " ") for k in range(0, len(words), 6400)])
    assert whole.shape == parts.shape and np.allclose(whole, parts, atol=0.02)
    assert quality_mil.passages(None).shape == (1, quality_mil.N_FEATURES)


def test_label_model_recovers_known_accuracies():
    r = np.random.default_rng(1)
    n, prior = 200_000, 0.3
    on, off = np.array([0.9, 0.8, 0.7, 0.6, 0.85]), np.array([0.05, 0.1, 0.1, 0.2, 0.02])
    y = r.random(n) < prior
    v = (r.random((n, 5)) < np.where(y[:, None], on, off)).astype(float)
    v = np.hstack([v, v[:, :1] * (r.random((n, 1)) < 0.95)])  # a sixth that copies the first
    w, b, acc, corr = toxicity.fit_label_model(v.T @ v, n, prior)
    var = prior * (1 - prior)
    want = (on - off)[1:] * np.sqrt(var) / v[:, 1:5].std(0)
    assert np.allclose(acc[1:5], want, atol=0.05) and [p[:2] for p in corr] == [(0, 5)]
    posterior = 1 / (1 + np.exp(-(v @ w + b)))
    assert ((posterior > 0.5) == y).mean() > 0.95


def test_a_label_repeated_often_is_one_row(spark):
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.explode(F.array_repeat(F.lit("some text"), 5000)).alias("text"))
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0), (None, 1)], "id long, y int")
    assert [tuple(r) for r in toxicity.training_sample(docs, labels, F.lit(True), "doc_id", "text", 100).collect()] == [(1, "some text", 1)]


def test_large_identifiers_stay_as_they_are(spark):
    ids = [9007199254740993, (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, "a b c d e f", "s") for i in ids], "doc_id long, text string, source string")
    assert Counter(r.id for r in packing.pack(df).collect()) == Counter(ids)
    assert {r.doc_id: r.dropped_lines for r in line_dedup.dedup_lines(df).collect()} == {ids[0]: [], ids[1]: [0], None: [0]}


def test_rows_without_identifiers_are_mixed_near_their_targets(spark):
    df = spark.createDataFrame([(None if k % 2 else 7, f"w {k % 500} " * 5, "a" if k % 3 else "b") for k in range(3000)], "doc_id long, text string, source string")
    for _ in range(2):
        got = {r.source: (r.t, r.target) for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
        assert all(abs(t - target) <= 20 for t, target in got.values())
    same = spark.createDataFrame([(7, "equal words here", "a" if k % 2 else "b") for k in range(3000)], "doc_id long, text string, source string")
    assert {r.source: r["sum(taken)"] for r in mixing.mix(same).groupBy("source").sum("taken").collect()} == {"a": 3000, "b": 6000}
    assert mixing.mixed(same).count() == 3000


def _targets(rows):
    names = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {n: (1, 2, 3)[k % 3] for k, (n, _) in enumerate(names)}
    left, fixed = sum(t for _, t in rows), {}
    while True:
        free = [(n, t) for n, t in rows if n not in fixed]
        total = sum(weight[n] for n, _ in free)
        new = {n: 3.0 * t for n, t in free if 3 * t <= weight[n] * (left - sum(fixed.values())) / total}
        if not new:
            return fixed | {n: weight[n] * (left - sum(fixed.values())) / total for n, _ in free}
        fixed |= new


@pytest.mark.parametrize("seed", range(3))
def test_targets_against_rounds(spark, seed):
    r = random.Random(seed)
    rows = [(f"s{k:02d}", int(10 ** (r.random() * 4))) for k in range(23)] + [(None, 50)]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(rows, "source string, total long")).collect()}
    want = _targets(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_license_words_must_stand_in_order(spark):
    bsd = next(t for t, x in license_scan.TEMPLATES if x == "bsd").split()
    texts = {"whole": bsd, "pairs": [x for p in zip(bsd, bsd[1:], strict=False) for x in p], "turned": bsd[::-1], "one more": [*bsd[:8], "extra", *bsd[8:]], "far apart": [*bsd[:10], *["x"] * 9, *bsd[10:]], "twice": [*bsd, "and", *bsd]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {name: r.labels for name, r in zip(texts, license_scan.scan(df).orderBy("id").collect(), strict=True)}
    assert got == {"whole": "bsd", "pairs": "", "turned": "", "one more": "bsd", "far apart": "", "twice": "bsd"}


def test_damaged_archives_are_rows():
    good = arc_warc.arc_record(1, "filedesc://a", "20200101000000", "text/plain", arc_warc.arc_block(1)) + b"\n" + arc_warc.arc_record(1, "u", "20200101000000", "text/html", b"abc") + b"\n"
    assert [(r["url"], r["error"]) for r in arc_warc.parse_arc(good)] == [("u", None)]
    assert [(r["url"], bool(r["error"])) for r in arc_warc.parse_arc(good + b"u2 0.0.0.0 20200101000000 text/html many\nabc")] == [("u", False), (None, True)]
    assert [(r["url"], bool(r["error"])) for r in arc_warc.parse_arc(good + b"u2 0.0.0.0 20200101000000 text/html 999\nabc")] == [("u", False), (None, True)]


@pytest.mark.parametrize("version", [1, 2])
def test_archive_records_keep_status_and_headers(spark, tmp_path, version):
    folder = f"{tmp_path}/arc"
    own = "1 0 x\nURL IP-address Archive-date Content-type Archive-length\n" if version == 1 else "2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    missing = b"HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\ngone"
    out = arc_warc.arc_record(version, "filedesc://a", "20200101000000", "text/plain", own.encode()) + b"\n"
    for url, mime, block in (("http://a/", "text/html", missing), ("dns:a", "text/dns", b"a 1 IN A 127.0.0.1"), ("http://b/", "text/html", missing)):
        out += arc_warc.arc_record(version, url, "20200101000000", mime, block, status="404") + b"\n"
    import os

    os.makedirs(folder)
    with open(f"{folder}/part-0.arc", "wb") as f:
        f.write(out)
    arc = arc_warc.read_arc(spark, folder)
    assert [(r.url, r.status, r.version) for r in arc.orderBy("seq").collect()] == [(u, "404" if version == 2 else None, version) for u in ("http://a/", "dns:a", "http://b/")]
    arc_warc.convert(arc, f"{tmp_path}/warc")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{tmp_path}/warc").collect()
    records = {h["warc-target-uri"]: (h, b) for r in rows for h, b in arc_warc.parse_warc(bytes(r.content))}
    assert records["http://a/"][1] == missing and records["http://a/"][0]["warc-type"] == "response"
    assert records["dns:a"][0]["warc-type"] == "resource" and records["dns:a"][0]["content-type"] == "text/dns"
    revisit, block = records["http://b/"]
    assert revisit["warc-type"] == "revisit" and block == b"HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\n"
    assert revisit["warc-refers-to"] == records["http://a/"][0]["warc-record-id"] and revisit["warc-payload-digest"] == records["http://a/"][0]["warc-payload-digest"]


def _rules(text):
    """Counts by plain loops."""
    text = text or ""
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    lines, before, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.strip(" \t\n\x0b\x0c\r"):
            dup += x in before
            before.add(x)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})


def test_rules_against_brute_force(spark):
    r = random.Random(6)
    texts = [None, "", " \n ", "a a a a"] + ["".join(r.choice(["a", "bb", "é#", "|", "x y", "\n", " ", "\t", "\n\n"]) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    for x in got:
        want = _rules(texts[x.id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x.kept == (not x.base_failed)


def test_cutoffs_reject_few_good_documents():
    from math import comb

    for n, x, p in ((30, 0, 0.2), (100, 2, 0.05), (400, 3, 0.05)):
        assert quality_rules.binomial_tail(x, n, p) == pytest.approx(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)))
    # 5000 good documents in bucket 0, 300 bad ones in bucket 9: cut. With 20 good ones no cutoff can be shown to be safe.
    for good, want in ((5000, True), (20, False)):
        got = quality_rules.choose_cutoffs([(0, "symbols", 0, good, 0), (0, "symbols", 9, 0, 300)])
        assert ((0, "symbols") in got) == want


def test_least_cost_openings():
    r = random.Random(3)
    sizes = [r.randrange(1, 4000) for _ in range(500)]
    where, offset, lengths = packing.pack_sizes(sizes)
    inside = Counter()
    for s, b in zip(sizes, where, strict=True):
        inside[b] += s
    assert all(used <= lengths[b] and lengths[b] == min(x for x in packing.LENGTHS if x >= used) for b, used in inside.items())
    assert sum(map(packing.cost, lengths)) <= min(sum(map(packing.cost, packing.best_fit(sizes, packing.LENGTHS, o)[2])) for o in packing.LENGTHS)
    # Alone, a piece of 300 opens the shortest bin that costs least for it.
    assert packing.pack_sizes([300])[2] == [512] and packing.pack_sizes([4000, 96])[2] == [4096]
    assert packing.best_fit([600, 500, 400], (512, 1024, 2048))[2] == [2048]


def test_maximal_runs(spark):
    r = random.Random(9)
    lines = [f"line {r.randrange(4)} x" for _ in range(40)]
    texts = ["\n".join(lines), "\n".join(["first y z", *lines[10:35], "last y z"]), "\n".join(lines)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.d, x.i, x.n) for x in line_dedup.repeated_runs(df).collect()}
    split = [t.split("\n") for t in texts]
    places = [(d, i) for d, t in enumerate(split) for i in range(len(t))]

    def longest(d, i):
        best = 0
        for e, j in places:
            if (e, j) < (d, i):
                n = 0
                while i + n < len(split[d]) and j + n < len(split[e]) and split[d][i + n] == split[e][j + n]:
                    n += 1
                best = max(best, n)
        return best

    n = {p: longest(*p) for p in places}
    assert got == {(d, i, n[d, i]) for d, i in places if n[d, i] * 3 >= 5 and n.get((d, i - 1), 0) != n[d, i] + 1}


def test_near_duplicates_of_real_texts_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.id: r.class_id for r in order_minhash.near_duplicates(rows).collect()}
    texts = {r.doc_id: order_minhash.word_hashes(r.text) for r in rows.collect()}
    ids = sorted((i for i in texts if len(texts[i])), key=lambda i: len(texts[i]))
    pairs = 0
    for a, x in enumerate(ids):
        for y in ids[a + 1 :]:
            if len(texts[x]) < 0.8 * len(texts[y]):
                break
            if order_minhash.similar(texts[x], texts[y]) is not None:
                pairs += 1
                assert got[x] == got[y]
    assert pairs > 50


def test_a_common_passage_does_not_join_texts(spark):
    r = random.Random(11)
    passage = [f"p{k}" for k in range(80)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(400)]
    copies = [[w if r.random() > 0.05 else f"z{r.randrange(10**6)}" for w in texts[0]] for _ in range(60)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts + copies)], "doc_id long, text string")
    got = Counter(x.class_id for x in order_minhash.near_duplicates(df).collect())
    assert got == Counter({0: 61}) + Counter({k: 1 for k in range(1, 400)})


def test_rows_can_be_made_from_any_row_type(spark):
    assert order_minhash.near_duplicates(spark.createDataFrame([Row(doc_id=1, text="x")])).count() == 1
