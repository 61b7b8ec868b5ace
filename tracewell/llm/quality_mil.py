"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is described by its words and characters: hashed words, classes of characters, and
how its words repeat, and encoded by a learned layer; gated attention, tanh and sigmoid branches multiplied, gives every passage its
weight; a linear layer on the weighted sum of the codes gives the score. All layers are learned together from labels of whole
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .toxicity import training_sample

#: Words in a passage; labelled training rows, and the most bytes that a training text may have. All rows are scored whole.
PASSAGE, MAX_TRAIN, MAX_BYTES = 64, 8_000, 1 << 19
HIDDEN, ATTENTION = 24, 12
#: Gradient steps of training, texts in each, their size; the same however many labels there are.
STEPS, BATCH, STEP = 1500, 64, 0.01
#: Bins of hashed words; classes of characters: letters one by one, upper-case letters, digits, symbols, and so on.
WORD_BINS = 48
CLASSES = [*"abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".", ",", "!?", ":;", "'\"", "()[]{}", "-_/\\~^@+=`", "\n", " \t\x0b\x0c\r"]
#: Then come the class of all other bytes, and counts of the passage's words.
N_COUNTS = 6
N_FEATURES = WORD_BINS + len(CLASSES) + 1 + N_COUNTS
#: Bytes of a text that are looked at together.
PIECE = 1 << 20

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    _CLASS[list(_chars.encode())] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of whole passages, about PIECE bytes each, longer only for longer words; a piece ends between words."""
    at = 0
    while len(raw) - at > PIECE:
        words = raw[at : at + PIECE].split()
        # The last word may be cut, and passages are not.
        whole = (len(words) - 1) // PASSAGE * PASSAGE
        if whole < PASSAGE:
            break
        text = raw[at : at + PIECE]
        b = np.frombuffer(text, np.uint8)
        inside = ~_SPACE[b]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        end = int(starts[whole])
        yield text[:end]
        at += end
    yield raw[at:]


def passages(text: str | None) -> np.ndarray:
    """(passages, N_FEATURES); a text without words is one passage of zeros."""
    out = [_described(piece) for piece in _pieces((text or "").encode("utf-8", "replace"))]
    out = [x for x in out if len(x)]
    return np.concatenate(out) if out else np.zeros((1, N_FEATURES), np.float32)


def _described(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    of = np.arange(n) // PASSAGE
    k = int(of[-1]) + 1
    words = np.bincount(of, minlength=k).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    # Bytes from a passage's first word up to the next passage's.
    begin = starts[::PASSAGE].copy()
    begin[0] = 0
    byte_of = np.repeat(np.arange(k), np.diff(np.append(begin, len(b))))
    n_classes = len(CLASSES) + 1
    classes = np.bincount(byte_of * n_classes + _CLASS[b], minlength=k * n_classes).reshape(k, n_classes)
    size = np.maximum(classes.sum(1), 1)[:, None]
    h = _word_hashes(_LOW[b], starts, ends)
    bins = np.bincount(of * WORD_BINS + (h >> np.uint64(40)).astype(np.int64) % WORD_BINS, minlength=k * WORD_BINS).reshape(k, WORD_BINS)
    order = np.lexsort((h, of))
    new = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (h[order][1:] != h[order][:-1])])
    distinct = np.bincount(of[order][new], minlength=k)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])
    counts = np.stack([
        words / PASSAGE, distinct / words, np.bincount(of, length, k) / words / 10, np.maximum.reduceat(length, np.arange(0, n, PASSAGE)) / 40,
        np.bincount(of[again], minlength=k) / words, np.bincount(of[np.isin(b[ends - 1], list(b"#*$%&|<>!?"))], minlength=k) / words,
    ], 1)
    return np.concatenate([bins / words[:, None], classes / size, counts], 1).astype(np.float32)


def _word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, of its bytes."""
    with np.errstate(over="ignore"):
        # Words of up to 8 bytes are looked at as a number, longer ones as several, one after another.
        h = (ends - starts).astype(np.uint64)
        padded = np.concatenate([b, np.zeros(8, np.uint8)])
        at, left = starts.astype(np.int64), np.arange(len(starts))
        while len(left):
            width = np.minimum(ends[left] - at[left], 8)
            v = padded[at[left][:, None] + np.arange(8)].astype(np.uint64)
            v[np.arange(8) >= width[:, None]] = 0
            x = (v << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
            y = (h[left] ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h[left] = y ^ (y >> np.uint64(29))
            at[left] += 8
            left = left[at[left] < ends[left]]
        return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]


def _start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "E": r.normal(0, 0.3, (N_FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "a": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
    }


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, dict]:
    """x: passages of several texts one after another; starts: where each text begins; bag: the text of each passage."""
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    s = (t * g) @ p["a"]
    s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    w = s / _sums(s, starts)[bag]
    z = _sums(w[:, None] * h, starts)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
    return y, {"h": h, "t": t, "g": g, "w": w, "z": z}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross entropy."""
    out, k = forward(p, x, starts, bag)
    d = (out - y) * weight / len(y)
    dz = d[:, None] * p["c"]
    dw = (dz[bag] * k["h"]).sum(1)
    ds = k["w"] * (dw - _sums(k["w"] * dw, starts)[bag])
    dtg = ds[:, None] * p["a"]
    dt, dg = dtg * k["g"] * (1 - k["t"] ** 2), dtg * k["t"] * k["g"] * (1 - k["g"])
    dh = k["w"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    da = dh * (1 - k["h"] ** 2)
    return {"E": x.T @ da, "e": da.sum(0), "V": k["h"].T @ dt, "U": k["h"].T @ dg, "a": ((k["t"] * k["g"]) * ds[:, None]).sum(0), "c": k["z"].T @ d, "b": np.array([d.sum()])}


def _bags(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    return np.concatenate(parts).astype(np.float64), starts, np.repeat(np.arange(len(parts)), sizes)


def fit(parts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Adam over mini-batches; the two classes weigh the same, then the bias is set to the classes' true shares."""
    everything = np.concatenate(parts)
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    parts = [np.clip((x - mean) / scale, -6, 6) for x in parts]
    p = _start(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    r = np.random.default_rng(seed)
    n1 = max(1.0, y.sum())
    n0 = max(1.0, len(y) - y.sum())
    weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    order = np.empty(0, int)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(y)):
            order = np.concatenate([order, r.permutation(len(y))])
        some, order = order[:BATCH], order[BATCH:]
        g = gradients(p, *_bags([parts[i] for i in some]), y[some], weight[some])
        for name, a in g.items():
            a = a + 1e-4 * p[name]
            m[name] = 0.9 * m[name] + 0.1 * a
            v[name] = 0.999 * v[name] + 0.001 * a * a
            p[name] = p[name] - STEP * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    p["b"] = p["b"] + np.log(n1 / n0)
    return Model(mean, scale, p)


def predict(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    x, starts, bag = _bags(parts)
    return forward(model.layers, np.clip((x - model.mean) / model.scale, -6, 6), starts, bag)[0]


def train(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TRAIN) -> Model | None:
    """labels: id, y. fold: a condition on id; only its labels are read. None without labels.

    The model is fitted on about limit labelled rows, one for each identifier, of texts of up to MAX_BYTES bytes. Null and empty
    texts are a bag of one empty passage. Columns beside the named ones are ignored.
    """
    short = docs.where(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) <= MAX_BYTES)
    sample = written(training_sample(short, labels, fold, id_col, text_col, limit), "quality-sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [passages(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "y": batch.column("y").cast(pa.int64()), "x": pa.array([g.tobytes() for g in got], pa.binary())})

    rows = sample.mapInArrow(features, "id long, y long, x binary").orderBy("id").toPandas()  # limit rows of some kB
    if not len(rows):
        return None
    return fit([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows["x"]], (rows["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row of docs, 0 to 1. Null and empty texts are a bag of one empty passage. Without a model: 0.5.

    Equal texts, repeated or not, score the same. An empty table gives an empty result; columns beside the two named ones are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 3,500 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text")
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for k in range(0, batch.num_rows, 256):
                    out[k : k + 256] = predict(model, [passages(t) for t in texts.slice(k, 256).to_pylist()])
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(out)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
