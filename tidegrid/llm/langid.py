"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary logistic classifier over hashed
character n-grams (1 to 3, letters only) predicts whether the text's language has that
bit set.  Loss-weighted decoding adds up, for each language, the logistic losses of its codeword
under the bits' margins, weighted by how reliable the bit was in training; the
language with the least loss wins, and a small gap to the next one flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import settle

UNKNOWN = "und"
DIMENSIONS = 1 << 13
#: Bounds of the training sample: at most so many documents of a language and so many in all, shared out evenly over however many languages there are.
#: What the driver gets of a document are its n-gram counts' square roots, at most 6 bytes for each dimension.
PER_LANGUAGE, TOTAL = 400, 3200
EPOCHS, BATCH, RATE = 10, 64, 0.3
AMBIGUOUS = 0.15

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> its own number if it is a letter, else 0."""
    if not _tables:
        _tables["letters"] = np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)
    return _tables["letters"]


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Square roots of the n-gram counts, hashed and scaled to length 1; None without letters."""
    if not text:
        return None
    a = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not a.any():
        return None
    a = np.concatenate(([0], a, [0])).astype(np.uint32)
    a = a[(a != 0) | np.concatenate(([True], a[:-1] != 0))]
    m1, m2, m3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    two = (a[:-1] * m1) ^ (a[1:] * m2 + np.uint32(7))
    three = (two[:-1] * m3) ^ (a[2:] * m1 + np.uint32(13)) if len(a) > 2 else two[:0]
    grams = np.concatenate(((a * m2) >> shift, (two * m3) >> shift, (three * m2) >> shift))
    x = np.sqrt(np.bincount(grams, minlength=dimensions)).astype(np.float32)
    return x / np.linalg.norm(x)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +-1: every split of the languages for up to 6 of them, else random ones, far apart."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if i == n - 1 or s >> i & 1 == 0 else -1 for s in splits] for i in range(n)], np.float32)
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        gap = ((bits - c @ c.T) / 2 + bits * np.eye(n)).min()
        if best is None or gap > best[0]:
            best = (gap, c)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(documents, languages) of (documents, dimensions)."""
        margin = x @ self.weights + self.bias
        return np.logaddexp(0, -margin[:, None, :] * self.codes[None]) @ self.trust


def fit(x: np.ndarray, langs: list[str], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 3) -> Model:
    """Train on rows of features() with their languages: AdaGrad on the mean logistic loss of all bits, every language weighing the same."""
    names, dimensions = sorted(set(langs)), x.shape[1]
    codes = codewords(len(names))
    bits = codes.shape[1]
    if len(names) < 2:
        return Model(names, codes, np.zeros((dimensions, bits), np.float32), np.ones(bits, np.float32), np.ones(bits, np.float32))
    of = np.searchsorted(names, langs)
    y, weight = codes[of], (len(langs) / len(names) / np.bincount(of))[of][:, None].astype(np.float32)
    w, b = np.zeros((dimensions, bits), np.float32), np.zeros(bits, np.float32)
    seen_w, seen_b, chance = np.full_like(w, 1e-4), np.full_like(b, 1e-2), np.random.default_rng(seed)
    for _ in range(epochs):
        order = chance.permutation(len(x))
        for at in range(0, len(order), batch):
            k = order[at : at + batch]
            g = -y[k] * weight[k] / (1 + np.exp(y[k] * (x[k] @ w + b))) / len(k)
            for value, step, seen in ((w, x[k].T @ g + np.float32(1e-5) * w, seen_w), (b, g.sum(0), seen_b)):
                seen += step * step
                value -= rate * step / np.sqrt(seen)
    right = ((y * (x @ w + b)) > 0).astype(np.float32)
    trust = np.clip(2 * (weight * right).mean(0) - 1, 0.05, 1)
    return Model(names, codes, w, b, (trust / trust.sum()).astype(np.float32))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, text): of each language that occurs the documents of the least hash of id and text, as many as all languages can have within the bounds.

    A language has min(per_language, total / number of languages) documents, at least one, or all of its own if these are
    fewer; of more than total different values of lang the most frequent are learnt, so that the sample never
    has more than total rows. Null texts and languages are left out; rows without an id take part; a row that is repeated counts once.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    often = settle(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(total), "languages")
    share = min(per_language, max(1, total // max(1, often.count())))
    chance = F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(1 << 40))
    # three times the share that is wanted, by the same hash, so that no language's rows need meet
    likely = known.join(often, "lang").where(chance < F.lit(float(1 << 40)) * 3 * share / F.col("n")).select("id", "lang", "text").distinct()
    order = W.partitionBy("lang").orderBy(chance, "id", "text")
    return likely.withColumn("k", F.row_number().over(order)).where(F.col("k") <= share).drop("k")


def _features_of(dimensions: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, lang, text in zip(f["id"], f["lang"], f["text"], strict=True):
                x = features(text, dimensions)
                if x is not None:
                    at = np.flatnonzero(x).astype(np.uint16)
                    rows.append((i or "", lang, at.tobytes(), x[at].tobytes()))
            yield pd.DataFrame(rows, columns=["id", "lang", "at", "value"])

    return run


def train(docs: DataFrame, dimensions: int = DIMENSIONS, **options) -> Model:
    """A model from labelled documents; the driver gets the n-grams of the bounded training sample only. Texts without letters are left out."""
    rows = sorted(map(tuple, training_sample(docs, **options).mapInPandas(_features_of(dimensions), "id string, lang string, at binary, value binary").collect()))
    x = np.zeros((len(rows), dimensions), np.float32)
    for i, (_, _, at, value) in enumerate(rows):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return fit(x, [r[1] for r in rows])


RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def predictor(model: Model, gap: float = AMBIGUOUS):
    """A function of a text column giving (lang, score, ambiguous).

    score is the softmax share of the winning language's loss, from 0 to 1.  A null or empty
    text or one without letters is "und" with score 0 and not ambiguous, and so is
    every text if the model knows no language.  ambiguous: the runner-up's share is within gap of the winner's.
    """
    sharp = 10.0

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: list[tuple] = [(UNKNOWN, 0.0, False)] * len(texts)
            for at in range(0, len(texts) if model.languages else 0, 256):
                found = [(i, x) for i, t in enumerate(texts.iloc[at : at + 256], at) if (x := features(t, model.weights.shape[0])) is not None]
                if not found:
                    continue
                losses = model.losses(np.stack([x for _, x in found]))
                share = np.exp(-sharp * (losses - losses.min(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                best = share.argmax(1)
                second = np.sort(share, 1)[:, -2] if share.shape[1] > 1 else np.zeros(len(found))
                for (i, _), k, p, q in zip(found, best, share.max(1), second, strict=True):
                    out[i] = (model.languages[k], float(p), bool(p - q < gap))
            yield pd.DataFrame(out, columns=RESULT.names)

    return F.pandas_udf(run, RESULT).asNondeterministic()  # else a filter and a projection would each run it


def identify(docs: DataFrame, model: Model, gap: float = AMBIGUOUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, ambiguous), one row per document row; see predictor() for odd texts."""
    made = docs.select(F.col(id_col), predictor(model, gap)(F.col(text_col)).alias("x"))
    return made.select(id_col, F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), F.col("x.ambiguous").alias("ambiguous"))
