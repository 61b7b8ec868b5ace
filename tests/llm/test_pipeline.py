"""The corpus pipeline: each stage against plain loops on its own input, and the whole run."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from tracewell.llm import mixing, order_minhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _texts() -> list[str | None]:
    r = random.Random(2)
    vocabulary = [f"word{k}" for k in range(4000)]
    texts = ["\n".join(" ".join(r.choice(vocabulary) for _ in range(20)) for _ in range(5)) for _ in range(30)]
    near = texts[0].split(" ")
    near[7] = "changed"
    passage = "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(3))
    return [*texts, texts[1], " ".join(near), *(t + "\n" + passage for t in texts[5:8]), "too short", None, "", "same words here " * 40]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(k if k != 20 else None, t, "en", "abc"[k % 3] if k % 7 else None, len(t or "")) for k, t in enumerate(_texts())]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def _words(text):
    return (text or "").split()


def _base_keeps(text):
    w = _words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w)


def _without_runs(rows):
    """Later copies of runs of lines that hold five words or more, by trying all runs in the order of identifiers."""
    at, out = {}, {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if at.setdefault(run, (d, i)) != (d, i) and sum(len(x.split()) for x in run) >= 5:
                    gone |= set(range(i, j))
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return {d: t for d, t in out.items() if t.split()}


def _one_of_each_class(rows):
    rows = sorted(rows.items(), key=lambda r: (r[0] is None, r[0] or 0))
    hashes, own = [order_minhash.word_hashes(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            if rows[x][1] == rows[y][1] or order_minhash.similar(hashes[x], hashes[y]) is not None:
                a, b = sorted((root(x), root(y)))
                own[b] = a
    return {rows[k][0]: rows[k][1] for k in range(len(rows)) if root(k) == k}


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    want = {k: t for k, t in ((r.doc_id, r.text) for r in docs.collect()) if _base_keeps(t)}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    expected = [lambda w: w, lambda w: _without_runs(w.items()), _one_of_each_class]
    for name, plain in zip(list(stages)[:3], expected, strict=True):
        docs = stages[name](spark, docs, folder)
        assert docs.columns == columns
        docs.write.mode("overwrite").parquet(f"{folder}/{name}")
        docs, want = spark.read.parquet(f"{folder}/{name}"), plain(want)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.id: r.copies for r in mixing.mix(docs).collect() if r.copies}) and max(copies.values()) <= 3
    mixed.write.mode("overwrite").parquet(f"{folder}/mixing")
    packed = stages["packing"](spark, spark.read.parquet(f"{folder}/mixing"), folder).collect()
    assert Counter(r.doc_id for r in packed) == copies and sum(r["size"] for r in packed) == sum(len(_words(want[k])) * n for k, n in copies.items())
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r["size"]) for r in again) == Counter((r.doc_id, r["size"]) for r in packed)


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
    assert os.path.exists(f"{at}/documents.parquet")
