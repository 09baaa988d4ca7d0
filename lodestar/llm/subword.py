"""Document classifier on learned subword embeddings.

A document is the average of learned vectors of its features: words, word
pairs, a mark for a word that repeats its predecessor, and byte n-grams, all
hashed into a fixed number of buckets. A softmax over the classes follows.
Vectors and softmax are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows. Averaging and the softmax's inner
product commute, so scoring needs one number per bucket; these are kept as
whole numbers, which makes sums independent of how rows are batched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lodestar.llm.common import sampled

BUCKETS, DIM, GRAMS = 1 << 17, 12, (3, 4, 5)
#: labelled rows that the fit takes at most (by hash of the id)
SAMPLE = 4000
#: bytes of feature rows that learning holds; those beyond are worked out again when their turn comes
HELD = 1 << 26
EPOCHS, RATE, SEED = 5, 0.5, 7
#: bytes that are hashed at once; longer texts are read in overlapping slices
SLICE = 1 << 21
FIXED = 1 << 20  # scale of the whole-number bucket scores
_M = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class _Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, as long as needed."""

    def __init__(self):
        self.p = self.q = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            inverse = np.uint64(pow(int(_M), -1, 1 << 64))
            self.p = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _M))])
            self.q = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, inverse))])
        return self.p[:n], self.q[:n]


_POWERS = _Powers()


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _M
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(47)).astype(np.int64) % BUCKETS


def features(buffer: np.ndarray, n: int) -> list[np.ndarray]:
    """Buckets of all features that start in the first ``n`` bytes of a text slice
    (the rest of ``buffer`` only completes n-grams), one array for each kind."""
    out = []
    b = buffer.astype(np.uint64)
    for g in GRAMS:
        last = min(n, len(b) - g + 1)
        if last > 0:
            code = b[:last].copy()
            for k in range(1, g):
                code = (code << np.uint64(8)) | b[k:last + k]
            out.append(_bucket(code, g))
    space = np.concatenate([[True], _SPACE[buffer[:n]], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    if len(start):
        p, q = _POWERS.get(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b[:n] + np.uint64(1)) * p[:n])])
        word = (total[end] - total[start]) * q[start]
        out.append(_bucket(word, 100))
        if len(word) > 1:
            pair = word[:-1] * np.uint64(31) + word[1:]
            out.append(np.where(word[:-1] == word[1:], BUCKETS, _bucket(pair, 101)))
    return out


def slices(raw: bytes):
    """(buffer, n) pieces of a text's bytes; cuts fall on white space where there is any."""
    at, overlap = 0, max(GRAMS) - 1
    while at < len(raw) or not at:
        end = min(len(raw), at + SLICE)
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            end = cut if cut > at else end
        yield np.frombuffer(raw[at:end + overlap], np.uint8), end - at
        if end >= len(raw):
            return
        at = end


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares of its features."""
    found = [x for buffer, n in slices((text or "").encode()) for x in features(buffer, n)]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int32), (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    """Bucket scores (difference of the two classes' logits, times FIXED) and bias."""
    score: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1, np.int64))
    bias: float = 0.0

    def probability(self, text: str | None) -> float:
        total = n = 0
        for buffer, size in slices((text or "").encode()):
            for ids in features(buffer, size):
                total += int(self.score[ids].sum())
                n += len(ids)
        z = self.bias + (total / n / FIXED if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


class Counted:
    """``counted`` of each text by its place, in memory up to HELD bytes."""

    def __init__(self, texts):
        self.texts, self.held, self.size = texts, {}, 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.held.get(k)
        if got is None:
            got = counted(self.texts[k].as_py())
            size = got[0].nbytes + got[1].nbytes
            if self.size + size <= HELD:
                self.held[k] = got
                self.size += size
        return got


def train(rows: Counted, labels: np.ndarray) -> Model:
    """Fit vectors and softmax by stochastic gradient descent, one document at a time."""
    rng = np.random.default_rng(SEED)
    y = np.asarray(labels, np.int64)
    prior = (np.bincount(y, minlength=2) + 0.5) / (len(y) + 1)
    model = Model(bias=float(np.log(prior[1] / prior[0])))
    if len(np.unique(y)) < 2:
        return model
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.log(prior).astype(np.float32)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            i, s = rows[k]
            if not len(i):
                continue
            own = vec[i]
            doc = s @ own
            z = out @ doc + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1  # gradient of the loss by the logits
            back = p @ out
            out -= rate * np.outer(p, doc)
            bias -= rate * 0.1 * p
            # a document's features share its step; scaled so that rare shares still learn
            vec[i] = own - (rate * len(i) ** 0.5) * s[:, None] * back[None, :]
    model.score = np.rint((vec @ (out[1] - out[0])).astype(np.float64) * FIXED).astype(np.int64)
    model.bias = float(bias[1] - bias[0])
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label 0/1) of a bounded sample: ``size`` labelled ids by hash, one row for each id."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        train_on & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = sampled(rows.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", size)
    # bounded by ``size`` rows of two numbers
    return (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))


def fit(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, size: int = SAMPLE) -> Model:
    """A model learned from at most ``size`` labelled rows that fulfil ``train_on``."""
    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        m = train(Counted(rows.column("text")), rows.column("label").to_numpy())
        return pa.table({"score": [m.score.tolist()], "bias": [m.bias]})

    rows = labelled(docs, labels, label, train_on, size)
    # at most ``size`` texts meet in one task, which learns; the driver gets BUCKETS + 2 numbers
    got = rows.select(F.lit(0).alias("all"), "doc_id", "label", "text").groupBy("all").applyInArrow(
        learn, "score array<long>, bias double").first()
    return Model(np.array(got["score"], np.int64), got["bias"]) if got else Model()


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with ``score``, the
    probability of label 1. Null and empty texts have no features: they get the
    bias's probability. The score depends on the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 numbers

    @pandas_udf("double")
    def f(t: pd.Series) -> pd.Series:
        return pd.Series([shared.value.probability(x) for x in t], dtype="float64")

    columns = columns or docs.columns
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), f(docs["text"]).alias("score"))


#: documents at or above this probability of label 1 are kept
THRESHOLD = 0.3


def kept_rows(docs: DataFrame, labels: DataFrame, train_on: Column) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return score(docs, fit(docs, labels, "quality", train_on)).where(F.col("score") >= THRESHOLD).select("doc.*")
