"""Toxicity by weak supervision.

Voters look at a text's words: groups of lexicon words (a general list and words induced from the training rows'
labels) and patterns (address, masked spellings, shouting). Each votes 1 or 0 for a text. The label model is
estimated from the votes' first and second moments over all texts, without labels: voters' accuracies are the
rank-one part of the votes' covariance, and what that leaves over for a pair is their correlation; correlated voters
share their weight. Its posteriors label a bounded sample, on which a linear classifier over votes and words is fitted.
The classifier scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A general list, by kind.
LEXICON = {
    "insult": "idiot moron imbecile stupid dumb fool loser clown cretin dimwit jerk".split(),
    "contempt": "trash scum worthless pathetic disgusting garbage vermin filth useless subhuman".split(),
    "abuse": "bastard bitch asshole shit fuck fucking cunt dick slut whore".split(),
    "threat": "kill die murder hang burn rape lynch strangle".split(),
}
#: Induced words are dealt to so many voters, PER each.
INDUCED_VOTERS, PER = 5, 12
#: Expected labelled training rows for lexicon and classifier; words that the classifier may use.
MAX_TRAIN, MAX_WORDS = 20_000, 400
#: A word is induced if it is in so many training texts, and so much likelier in toxic ones.
MIN_TEXTS, MIN_RATIO = 5, 8.0
#: Two voters count as correlated from this standardised residual on.
CORRELATED = 0.15

WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
MASK = str.maketrans("013457@$!", "oieastasi")
MASKED = re.compile(r"[a-z0-9@$!]{3,}")
SPELT = re.compile(r"\b(?:[a-z][.\-*_ ]){3,}[a-z]\b")


@dataclass
class Model:
    voters: list[list[str]]
    names: list[str]
    vote_weights: list[float] = field(default_factory=list)
    vote_bias: float = 0.0
    accuracies: list[float] = field(default_factory=list)
    correlations: list[tuple[int, int, float]] = field(default_factory=list)
    words: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0


def words_of(text: str | None) -> tuple[str, list[str]]:
    """The text in lower case and its words."""
    low = (text or "").lower()
    return low, WORD.findall(low)


def _is_masked(low: str, bad: frozenset[str]) -> bool:
    """Whether a word of the lexicons is spelt with digits or marks, or letter by letter. Linear in the text's length."""
    for m in MASKED.finditer(low):
        t = m.group()
        if not t.isalpha() and not t.isdigit() and t.rstrip("!").translate(MASK) in bad and t.rstrip("!") not in bad:
            return True
    return any(re.sub(r"[^a-z]", "", m.group()) in bad for m in SPELT.finditer(low))


def votes_of(low: str, words: list[str], groups: list[frozenset[str]], everything: frozenset[str]) -> list[int]:
    """One vote for each group of words, then the pattern voters. everything: all groups' words."""
    keys = set(words)
    bad = keys & everything
    out = [int(not bad.isdisjoint(g)) for g in groups]
    n = len(words)
    dense = sum(w in bad for w in words) if bad else 0
    out.append(int(len(bad) >= 2))
    out.append(int(n > 0 and dense * 200 >= n and dense > 0))
    out.append(int(bool(bad) and re.search(rf"\b(?:you|your|they|he|she)\b[^.!?]{{0,40}}\b(?:{'|'.join(map(re.escape, sorted(bad)))})\b", low) is not None))
    out.append(int(_is_masked(low, everything)))
    out.append(int(low.count("!") * 10 > n > 0))
    return out


PATTERNS = ["several", "dense", "address", "masked", "shouting"]


def _expected(corr: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For each pair (i, j) the median, over other voters k and l, of c(i, k) c(j, l) / c(k, l): its correlation, if all are independent given the label."""
    m = len(corr)
    out = corr.copy()
    usable = free & (corr > 0.05)
    for i in range(m):
        for j in range(i + 1, m):
            k, l = np.nonzero(usable & free[i][:, None] & free[j][None, :])
            ok = (k != j) & (l != i)
            if free[i, j] and ok.any():
                k, l = k[ok], l[ok]
                out[i, j] = out[j, i] = np.median(corr[i, k] * corr[j, l] / corr[k, l])
    return out


def fit_label_model(moments: np.ndarray, total: int, prior: float) -> tuple[np.ndarray, float, np.ndarray, list[tuple[int, int, float]]]:
    """moments: summed outer products of votes, the sums themselves on the diagonal -> weights, bias, accuracies, correlations.

    cov(i, j) = prior (1 - prior) d_i d_j for voters that are independent given the label, with d = P(1 | toxic) -
    P(1 | clean). Pairs far from what that lets expect are correlated; the vector is fitted on all others.
    """
    mean = np.diag(moments) / max(total, 1)
    cov = moments / max(total, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    m = len(mean)
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free = ~np.eye(m, dtype=bool)
    live = sd > 1e-5
    free &= np.outer(live, live)
    a = np.full(m, 0.5) * live
    pairs: set[tuple[int, int]] = set()
    # The pair that stands out most from what other voters let expect is called correlated, until none does or too few pairs are
    # left to tell accuracies from. Expectations are medians, which a few correlated pairs don't move.
    while free.sum() > 2 * m:
        rest = np.abs(corr - _expected(corr, free)) * free
        k = np.unravel_index(rest.argmax(), rest.shape)
        if rest[k] < CORRELATED:
            break
        free[k] = free[k[::-1]] = False
        pairs.add((int(min(k)), int(max(k))))
    for _ in range(200):
        for i in range(m):
            w = free[i] * 1.0
            den = (w * a * a).sum()
            a[i] = np.clip((w * corr[i] * a).sum() / den, 0.0, 0.98) if den > 1e-9 and live[i] else 0.0
    found = [(i, j, float(corr[i, j] - a[i] * a[j])) for i, j in sorted(pairs)]
    var = max(prior * (1 - prior), 1e-6)
    d = a * sd / np.sqrt(var)
    on = np.clip(mean + (1 - prior) * d, 1e-4, 1 - 1e-4)  # P(vote 1 | toxic)
    off = np.clip(mean - prior * d, 1e-5, 1 - 1e-4)
    on = np.maximum(on, off)
    share = np.ones(m)
    for i, j, r in found:
        share[i] += abs(r)
        share[j] += abs(r)
    w = (np.log(on / off) - np.log((1 - on) / (1 - off))) / share
    b = np.log(prior / (1 - prior)) + (np.log((1 - on) / (1 - off)) / share).sum()
    w[~live] = 0
    return w, float(b), a, found


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; the ridge spares the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    r = np.full(len(w), ridge)
    r[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + r * w
        h = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(r)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _rows(batches: Iterator[pa.RecordBatch], *cols: str):
    for batch in batches:
        yield batch, zip(*(batch.column(c).to_pylist() for c in cols), strict=True)


def training_sample(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str, text_col: str, limit: int) -> DataFrame:
    """id, text, y of labelled rows in the fold, about limit of them: all, or those with the smallest hashes of the identifier.

    A label given several times counts once, with its largest value; of rows that share an identifier one is used, that with
    the smallest text, so repeated rows can't make the sample larger. Null identifiers and labels are left out.
    """
    marks = labels.where(F.col("y").isNotNull() & F.col("id").isNotNull() & fold).groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    if n > limit:
        # A cut through the hashes' range: bounded in expectation, the same rows at every run.
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * limit / n))
    chosen = F.broadcast(marks)  # about limit rows of two numbers
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(chosen, "id")
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def lexicon(sample: DataFrame) -> tuple[Model, int, int]:
    """Voters and vocabulary from the labelled sample, and how many of its texts are toxic and not."""

    def count(batches):
        on: dict[str, int] = {}
        off: dict[str, int] = {}
        n = [0, 0]
        for _, rows in _rows(batches, "text", "y"):
            for text, y in rows:
                into = on if y else off
                for w in set(words_of(text)[1]):
                    into[w] = into.get(w, 0) + 1
                n[bool(y)] += 1
        keys = list(on.keys() | off.keys())
        yield pa.record_batch({"word": pa.array([*keys, ""]), "pos": pa.array([*(on.get(k, 0) for k in keys), n[1]], pa.int64()), "neg": pa.array([*(off.get(k, 0) for k in keys), n[0]], pa.int64())})

    words = written(sample.mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-words")
    totals = words.where("word = ''").first()
    n1, n0 = (totals["pos"], totals["neg"]) if totals else (0, 0)
    ratio = ((F.col("pos") + 0.5) / (n1 + 1.0)) / ((F.col("neg") + 0.5) / (n0 + 1.0))
    top = words.where("word <> ''").where(F.col("pos") + F.col("neg") >= MIN_TEXTS).withColumn("ratio", ratio)
    induced = [r["word"] for r in top.where((F.col("ratio") >= MIN_RATIO) & (F.col("pos") >= 3)).orderBy(F.desc(F.col("ratio") * F.sqrt(F.col("pos"))), "word").limit(INDUCED_VOTERS * PER).collect()] if n1 and n0 else []
    odd = [r["word"] for r in top.orderBy(F.desc(F.abs(F.log("ratio")) * F.sqrt(F.col("pos") + F.col("neg"))), "word").limit(MAX_WORDS).collect()] if n1 and n0 else []
    voters = [*LEXICON.values(), *(induced[k::INDUCED_VOTERS] for k in range(INDUCED_VOTERS))]
    names = [*LEXICON, *(f"induced{k}" for k in range(INDUCED_VOTERS)), *PATTERNS]
    return Model([list(v) for v in voters], names, words={x: k for k, x in enumerate(odd)}), n1, n0


def features(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, v (a bit for each voter), f (numbers of the vocabulary's words) for every row of docs, in one pass over its texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.voters, model.words))  # a few hundred words

    def run(batches):
        voters, vocabulary = shared.value
        groups = [frozenset(v) for v in voters]
        everything = frozenset().union(*groups)
        for batch, rows in _rows(batches, "text"):
            v, f = [], []
            for (text,) in rows:
                low, words = words_of(text)
                v.append(sum(b << k for k, b in enumerate(votes_of(low, words, groups, everything))))
                f.append(sorted(vocabulary[w] for w in vocabulary.keys() & set(words)))
            yield pa.record_batch({"id": batch.column("id"), "v": pa.array(v, pa.int32()), "f": pa.array(f, pa.list_(pa.int32()))})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, v int, f array<int>")


def fit(model: Model, found: DataFrame, sample: DataFrame, n1: int, n0: int) -> Model:
    """found: features() of all documents; sample: the labelled rows. Fills in the label model and the classifier."""
    m = len(model.names)
    # Over all documents: rows with the same votes are counted first, so 2^m rows at most are moved, a few hundred in practice.
    second, total = np.zeros((m, m)), 0
    for row in found.groupBy("v").agg(F.count("*").alias("n")).collect():
        on = [k for k in range(m) if row["v"] >> k & 1]
        second[np.ix_(on, on)] += row["n"]
        total += row["n"]
    prior = min(max((n1 + 1) / (n1 + n0 + 2), 0.001), 0.5) if n1 + n0 else 0.05
    w, b, acc, corr = fit_label_model(second, total, prior)
    model.vote_weights, model.vote_bias, model.accuracies, model.correlations = w.tolist(), b, acc.tolist(), corr
    chosen = F.broadcast(sample.select("id"))  # MAX_TRAIN rows of a number, about
    got = found.join(chosen, "id").groupBy("id").agg(F.min(F.struct("v", "f")).alias("x")).select("id", "x.v", "x.f").orderBy("id").toPandas()
    x, y = np.zeros((len(got), m + len(model.words))), np.zeros(len(got))
    for i, (v, f) in enumerate(zip(got["v"], got["f"], strict=True)):
        x[i, :m] = [v >> k & 1 for k in range(m)]
        x[i, m + np.asarray(f, int)] = 1
        y[i] = 1 / (1 + np.exp(-np.clip(x[i, :m] @ w + b, -30, 30)))
    if len(got):
        weights, model.bias = fit_linear(x, y)
    else:
        weights, model.bias = np.concatenate([w, np.zeros(len(model.words))]), b
    model.weights = weights.tolist()
    return model


def scored(found: DataFrame, model: Model) -> DataFrame:
    """features() -> id, score."""
    m = len(model.names)
    votes = F.lit(float(model.bias))
    for k, w in enumerate(model.weights[:m]):
        votes = votes + F.when(F.col("v").bitwiseAND(1 << k) != 0, float(w)).otherwise(0.0)
    weights = F.array(*map(F.lit, [*map(float, model.weights[m:]), 0.0]))
    z = F.aggregate("f", votes, lambda acc, i: acc + F.get(weights, i))
    return found.select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def train_and_score(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TRAIN) -> tuple[Model, DataFrame]:
    """The model, and id, score (0 to 1) for every row of docs; texts are read once beside the labelled sample.

    labels: id, y. fold: a condition on id; only its labels are read. Null and empty texts score what no word at all scores;
    rows with equal texts, repeated or not, score the same; ties between words go by code point. Without labels the label model's
    prior is 0.05 and its posterior is the score. An empty table gives an empty result; columns beside the named ones are ignored.
    """
    sample = written(training_sample(docs, labels, fold, id_col, text_col, limit), "toxic-sample")
    model, n1, n0 = lexicon(sample)
    found = written(features(docs, model, id_col, text_col), "toxic-features")
    fit(model, found, sample, n1, n0)
    return model, scored(found, model)


def train(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TRAIN) -> Model:
    """The model alone, for score(); see train_and_score()."""
    return train_and_score(docs, labels, fold, id_col, text_col, limit)[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row of docs, by a model trained before; see train_and_score()."""
    return scored(features(docs, model, id_col, text_col), model)
