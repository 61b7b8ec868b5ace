"""Toxicity and quality: held-out rows, nulls, empty and repeated rows, empty tables, other columns; gradients against differences."""

import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.llm import quality_mil, toxicity

COLS = "doc_id long, text string, id long, y int, score double"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _corpus(spark, make):
    r = random.Random(3)
    texts = [(k, make(r, k % 3 == 0), int(k % 3 == 0)) for k in range(300)]
    rows = [(k, t, 9, 9, 9.0) for k, t, _ in texts]
    odd = [(900, None, 9, 9, 9.0), (901, "", 9, 9, 9.0), (None, "plain words", 9, 9, 9.0), (902, "plain words " * 20000, 9, 9, 9.0), (0, texts[0][1], 9, 9, 9.0)]
    labels = spark.createDataFrame([*((k, y) for k, _, y in texts), (None, 1), (5, None)], "id long, y int")
    return spark.createDataFrame(rows + odd, COLS), labels, {k: y for k, _, y in texts}


def _check(scored, truth, n):
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    held = [(r.score, truth[r.id]) for r in scored if r.id in truth and r.id % 2]
    right = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert np.mean(right) > 0.95
    odd = {r.id: r.score for r in scored if r.id in (900, 901)}
    assert odd[900] == odd[901]
    assert len({r.score for r in scored if r.id == 0}) == 1


FOLD = "id % 2 = 0"


def test_toxicity(spark):
    def make(r, bad):
        w = [f"w{r.randrange(200)}x".replace("0", "o") for _ in range(60)]
        return " ".join(w + r.sample(["idiot", "moron", "trash", "scum", "vermin"], 3) if bad else w)

    docs, labels, truth = _corpus(spark, make)
    model = toxicity.train(docs, labels, F.expr(FOLD))
    _check(toxicity.score(docs, model).collect(), truth, docs.count())


def test_quality(spark):
    def make(r, good):
        w = [f"w{r.randrange(200)}" for _ in range(200)]
        return " ".join(w) + "." if good else "#|# ".join(w)

    docs, labels, truth = _corpus(spark, make)
    model = quality_mil.train(docs, labels, F.expr(FOLD))
    _check(quality_mil.score(docs, model).collect(), truth, docs.count())


def test_without_rows_or_labels(spark):
    docs, labels, _ = _corpus(spark, lambda r, y: "some words")
    for operator in (toxicity, quality_mil):
        model = operator.train(docs, labels.limit(0), F.expr(FOLD))
        assert all(0 <= r.score <= 1 for r in operator.score(docs, model).collect())
        model = operator.train(docs.limit(0), labels, F.expr(FOLD))
        assert operator.score(docs.limit(0), model).count() == 0


def test_gradients_of_attention():
    r = np.random.default_rng(4)
    p = {k: v + r.normal(0, 0.1, v.shape) for k, v in quality_mil._start().items()}
    x, starts, bag = quality_mil._bags([r.normal(size=(n, quality_mil.N_FEATURES)) for n in (1, 3, 5)])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        out = quality_mil.forward(p, x, starts, bag)[0]
        return -(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).mean()

    for name, g in quality_mil.gradients(p, x, starts, bag, y, weight).items():
        at = tuple(r.integers(0, s) for s in p[name].shape)
        kept = p[name][at]
        sides = []
        for step in (1e-5, -1e-5):
            p[name][at] = kept + step
            sides.append(loss())
        p[name][at] = kept
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)
