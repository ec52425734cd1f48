"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded (shapes of words, signs and a
few ratios through a learnt layer), a gated attention tells how much it speaks for its document, and the
classifier scores the weighted mean of the encodings. Encoder, attention and classifier are
learnt together from document labels by Adam on the logistic loss of bags.

The attention is a sum over passages (weights times encodings, and weights), so a text of any length is scored
piece by piece, and all of it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, text_of

PASSAGE = 64
SHAPES, SIGNS, RATIOS = 256, 64, 10
HIDDEN, GATES = 24, 12
#: Bounds of the training sample: documents of each label, and passages of a document (evenly spaced), each of at most 2 bytes a feature.
PER_LABEL, PER_DOCUMENT = 1500, 32
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.01, 1e-4
#: Code points that are read at a time; a word is cut where a piece ends.
PIECE = 1 << 19
FEATURES = SHAPES + SIGNS + RATIOS

_tables: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """Code point -> 0 ASCII white space, 1 letter that isn't a capital, 2 capital, 3 digit, 4 anything else."""
    if not _tables:
        white = frozenset(" \t\n\x0b\x0c\r")
        of = lambda c: 0 if c in white else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4
        _tables["kinds"] = np.fromiter((of(chr(i)) for i in range(0x110000)), np.uint8, 0x110000)
        _tables["powers"] = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    return _tables["kinds"]


def _hashes(codes: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's codes; first: where words begin, word: each code's word."""
    at = (np.arange(len(codes)) - first[word]) & 63
    sums = np.add.reduceat((codes.astype(np.uint64) + np.uint64(0x51)) * _tables["powers"][at], first)
    return (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def passages(text: str) -> np.ndarray:
    """(passages, FEATURES) of a text; passages are of about 64 words each, one without features for a text without words."""
    kinds = _kinds()
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kinds[a]
    inside = k != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    n = int(begins.sum())
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    word = (np.cumsum(begins) - 1)[inside]
    lines = np.flatnonzero(a == 10)
    before = np.clip(np.cumsum(begins)[lines] - 1, 0, None) if len(lines) else lines
    a, k = a[inside], k[inside]
    length = np.bincount(word)
    first = np.cumsum(length) - length
    m = max(1, round(n / PASSAGE))
    of = np.arange(n) * m // n
    place = of[word]
    words, chars = np.bincount(of, minlength=m), np.bincount(place, minlength=m)

    sign = np.where(k == 4, a, k)
    new = np.ones(len(a), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (word[1:] != word[:-1])
    short = np.bincount(word[new])
    shape = _hashes(sign[new], np.cumsum(short) - short, word[new]) >> np.uint64(40)
    shapes = np.bincount(of * SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64), minlength=m * SHAPES).reshape(m, SHAPES)
    other = k == 4
    signs = np.bincount(place[other] * SIGNS + (a[other] * np.uint32(0x9E3779B1) >> np.uint32(26)), minlength=m * SIGNS).reshape(m, SIGNS)

    full = _hashes(a, first, word)
    seen, often = np.unique((of.astype(np.uint64) << np.uint64(32)) | (full >> np.uint64(32)), return_counts=True)
    home = (seen >> np.uint64(32)).astype(np.int64)
    distinct = np.bincount(home, minlength=m)
    most = np.maximum.reduceat(often, np.cumsum(distinct) - distinct)
    again = np.zeros(n, bool)
    again[1:] = full[1:] == full[:-1]
    part = lambda mask: np.bincount(place[mask], minlength=m) / chars
    spread = np.sqrt(np.maximum(0, np.bincount(of, length.astype(float) ** 2, m) / words - (chars / words) ** 2))
    ratios = [words / PASSAGE, chars / words / 10, spread / 10, part(k == 2), part(k == 3), part(other), distinct / words, most / words, np.bincount(of[again], minlength=m) / words, np.bincount(of[before], minlength=m) / words]
    return np.concatenate((np.sqrt(shapes / words[:, None]), np.sqrt(signs / chars[:, None]), np.stack(ratios, 1)), 1).astype(np.float32)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """passages() of the whole text, a bounded piece of it at a time."""
    for at in range(0, max(1, len(text or "")), PIECE):
        yield passages((text or "")[at : at + PIECE])


@dataclass
class Model:
    """weights: by name, None where there were not two labels to learn from; base: the score without them."""

    weights: dict[str, np.ndarray] | None
    base: float

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        w, top, total = self.weights, 0.0, 0.0
        for x in pieces(text):
            h, gate, _, _ = _encode(w, x)
            e = np.exp(gate @ w["a"])
            top, total = top + e @ h, total + e.sum()
        return float(1 / (1 + np.exp(-np.clip(top / total @ w["v"] + w["c"][0], -30, 30))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _encode(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Encodings, gated attention units, and the two halves of these. Units are between -1 and 1, so weights stay bounded."""
    h = np.tanh((x - w["mean"]) * w["scale"] @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    return h, t * s, t, s


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss of bags; x: passages of all bags in order, sizes: how many each bag has."""
    at = np.cumsum(sizes) - sizes
    h, g, t, s = _encode(w, x)
    e = np.exp(g @ w["a"])
    p = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(p[:, None] * h, at)
    dl = weight * (_sigmoid(z @ w["v"] + w["c"]) - y) / len(y)
    dz = np.repeat(dl, sizes)[:, None] * w["v"]
    dp = (dz * h).sum(1)
    de = p * (dp - np.repeat(np.add.reduceat(p * dp, at), sizes))
    dg = de[:, None] * w["a"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (p[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    return {"W": ((x - w["mean"]) * w["scale"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": g.T @ de, "v": z.T @ dl, "c": dl.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: list[int], counts: tuple[int, int] | None = None, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 5) -> Model:
    """Learn from bags of passages; counts: how often labels 0 and 1 occur where the bags come from, so that scores are shares of the whole."""
    y = np.array(labels, np.float32)
    had = np.array([(y == 0).sum(), (y == 1).sum()], float)
    real = np.array(counts if counts is not None else had, float)
    base = float((real[1] + 1) / (real.sum() + 2))
    if not had.all():
        return Model(None, base)
    weight = np.where(y == 1, *(real / real.sum() * len(y) / had)[::-1]).astype(np.float32)
    x, chance = np.concatenate(bags), np.random.default_rng(seed)
    random = lambda *size: chance.normal(0, 1 / np.sqrt(size[0]), size).astype(np.float32)
    w = {"W": random(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": random(HIDDEN, GATES), "U": random(HIDDEN, GATES), "a": random(GATES), "v": random(HIDDEN), "c": np.full(1, np.log(base / (1 - base)), np.float32)}
    learnt, fixed = tuple(w), {"mean": x.mean(0), "scale": 1 / (x.std(0) + np.float32(0.05))}
    w |= fixed
    one, two, step = {k: np.zeros_like(w[k]) for k in learnt}, {k: np.zeros_like(w[k]) for k in learnt}, 0
    for epoch in range(epochs):
        order = chance.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            found = _gradients(w, np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), y[some], weight[some])
            step += 1
            for k in learnt:
                g = found[k] + decay * w[k]
                one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g * g
                w[k] = w[k] - rate * (1 - epoch / epochs) * one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Model({k: v.astype(np.float32) for k, v in w.items()}, base)


def training_bags(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, per_document: int = PER_DOCUMENT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, tuple[int, int]]:
    """((id, label, n, data), (rows labelled 0, rows labelled 1)): of each label the documents of the least hash of their id, at most per_label.

    Rows without an id and labels other than 0 and 1 are left out. A document that has both labels can be learnt with both;
    where rows repeat an id the least text counts. A document of more than per_document passages gives that many evenly spaced ones.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    often = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = (often.get(0, 0), often.get(1, 0))
    chance = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 40))
    # three times what is wanted, by the same hash, so that a label's rows need not meet
    likely = known.where(chance < F.lit(float(1 << 40)) * 3 * per_label / F.when(F.col("label") == 1, max(1, counts[1])).otherwise(max(1, counts[0]))).distinct()
    picked = settle(likely.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(chance, "id"))).where(F.col("k") <= per_label).select("id", "label"), "labelled")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, label, text in zip(f["id"], f["label"], f["text"], strict=True):
                x = np.concatenate(list(pieces(text)))
                x = x[np.unique(np.linspace(0, len(x) - 1, per_document).round().astype(int))] if len(x) > per_document else x
                rows.append((i, label, len(x), x.astype(np.float16).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "label", "n", "data"])

    # at most 2 * per_label ids
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return texts.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, label int, n int, data binary"), counts


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from labelled documents; the driver gets the features of the bounded training sample only."""
    made, counts = training_bags(docs, labels, **options)
    rows = sorted(map(tuple, made.collect()))
    return fit([np.frombuffer(r[3], np.float16).reshape(r[2], FEATURES).astype(np.float32) for r in rows], [r[1] for r in rows], counts)


def scorer(model: Model):
    """A function of a text column giving the score, from 0 to 1: the share of documents like this one that have label 1. Null counts as empty, which has a score too."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()  # else a filter and a projection would each run it


def score(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted), one row per document row; predicted is 1 from a score of least on."""
    made = docs.select(F.col(id_col), scorer(model)(text_of(text_col)).alias("score"))
    return made.select(id_col, "score", (F.col("score") >= least).cast("int").alias("predicted"))
