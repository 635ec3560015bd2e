"""Quality classifier by supervised subword embeddings (operator 1).

A document is the average of learned vectors of its hashed features: words,
word bigrams (whether the pair is new in the text, already seen, or one word
twice), and character n-grams inside words.  A softmax layer turns the average
into the probability of label 1.  Vectors and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows.

Texts are read whole, as UTF-8 bytes with runs of white space folded to one
space; hashing is done on the byte array, so the cost per byte is the same for
any vocabulary.  After training each bucket's vector is folded with the
softmax layer into one number, so scoring needs one table of ``BUCKETS``
floats (256 KB) whatever the data holds.

Edge cases: NULL and empty texts score the bias alone; NULL labels are left
out; several labels of one id count as 1 if any is 1; with no labelled row, or
one class only, the score is the share of label 1 in the sample (0.5 without
any); rows repeat as given; a NULL ``doc_id`` is scored and never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.llm.common import id_fold

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 8
#: Bound of the training sample, per class (rows are taken in hash order).
SAMPLE_PER_CLASS = 3000
#: Labelled rows with this crc32 remainder are never learned from.
HELD_FOLD, FOLDS = 0, 5
THRESHOLD = 0.3
_NGRAMS = (3, 4)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_PIECE = 1 << 20


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(kind)) * _MUL
        h ^= h >> np.uint64(29)
        h *= _MUL
    return (h >> np.uint64(64 - 16)).astype(np.int64)


def feature_groups(text: str | None) -> list[np.ndarray]:
    """Hashed feature ids of a text, one array per feature kind."""
    s = " ".join((text or "").split())
    if not s:
        return []
    x = np.frombuffer(f" {s} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = np.flatnonzero(x == 32)
    wide = x.astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in _NGRAMS:
            if len(x) < n:
                continue
            h = np.zeros(len(x) - n + 1, dtype=np.uint64)
            inside = np.ones(len(h), dtype=bool)
            for k in range(n):
                h = h * _BASE + wide[k:len(x) - n + 1 + k]
                if 0 < k < n - 1:
                    inside &= x[k:len(x) - n + 1 + k] != 32
            out.append(_bucket(h[inside], n))
        power = np.cumprod(np.full(len(x), _BASE, dtype=np.uint64))
        total = np.cumsum(wide * power, dtype=np.uint64)
        back = np.cumprod(np.full(len(x), _INV, dtype=np.uint64))
        word = (total[space[1:] - 1] - total[space[:-1]]) * back[space[:-1]]
        out.append(_bucket(word, 11))
        if len(word) > 1:
            pair = word[:-1] * _MUL + word[1:]
            first = np.zeros(len(pair), dtype=np.int64)
            first[np.unique(pair, return_index=True)[1]] = 1
            kind = np.where(word[:-1] == word[1:], 2, first)
            out.append(_bucket(kind.astype(np.uint64), 12))
            out.append(_bucket(pair, 13))
    return out


def weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse average of a text: bucket ids and weights (each kind sums to 1)."""
    groups = feature_groups(text)
    if not groups:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    ids = np.concatenate(groups)
    w = np.concatenate([np.full(len(g), 1.0 / max(1, len(g))) for g in groups])
    u, inv = np.unique(ids, return_inverse=True)
    return u.astype(np.int32), np.bincount(inv, weights=w).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Logit of label 1 per bucket, and the bias."""

    bucket: np.ndarray
    bias: float

    def logit(self, text: str | None) -> float:
        return self.bias + sum(float(self.bucket[g].mean(dtype=np.float64)) for g in feature_groups(text) if len(g))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over sparse averages with labels 0/1."""
    ones = sum(y for *_, y in rows)
    if ones in (0, len(rows)):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((ones + 0.5) / (len(rows) - ones + 0.5))))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), dtype=np.float32)
    bias = np.log(np.array([len(rows) - ones, ones]) / len(rows)).astype(np.float32)
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, w, y = rows[k]
            rate = np.float32(0.5 * (1 - step / steps) + 0.005)
            step += 1
            h = w @ emb[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, h)
            bias -= rate * np.float32(0.1) * p
            if len(ids):
                emb[ids] -= rate * np.outer(w, back)
    return Model((emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def training_sample(labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, label): at most ``per_class`` labelled ids of each class outside
    the held-out fold, taken in hash order so the choice ignores row order."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("label")).dropna()
             .filter(id_fold(F.col("doc_id"), FOLDS) != HELD_FOLD).groupBy("doc_id").agg(F.max("label").alias("label")))
    classes = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return classes[0].unionByName(classes[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from the bounded sample; its sparse features come to the driver
    (at most ``2 * per_class`` rows).  Repeated rows of an id count once."""
    sample = F.broadcast(training_sample(labels, per_class))  # at most 2 * per_class ids
    share = labels.select("doc_id", "quality").dropna().filter(id_fold(F.col("doc_id"), FOLDS) != HELD_FOLD).agg(
        F.avg(F.col("quality").cast("double"))).first()[0]

    @F.pandas_udf("struct<ids:binary,w:binary>")
    def featurise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            pairs = [weights(t) for t in s]
            yield pd.DataFrame({"ids": [a.tobytes() for a, _ in pairs], "w": [b.tobytes() for _, b in pairs]})

    got = (docs.select("doc_id", "text").join(sample, "doc_id")
           .select("doc_id", "label", F.xxhash64("text").alias("h"), featurise("text").alias("f")))
    rows = sorted({(r["doc_id"], r["h"]): r for r in got.toLocalIterator()}.items())
    data = [(np.frombuffer(r["f"]["ids"], np.int32), np.frombuffer(r["f"]["w"], np.float32), int(r["label"])) for _, r in rows]
    if not data:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    model = train(data)
    # The sample is balanced by class; shift the bias back to the labels' share.
    ones = sum(y for *_, y in data)
    if share is not None and 0 < share < 1 and 0 < ones < len(data):
        shift = np.log(share / (1 - share)) - np.log(ones / (len(data) - ones))
        model = Model(model.bucket, model.bias + float(shift))
    return model


def score_column(spark, model: Model, text: Column) -> Column:
    """Probability of label 1 of each text."""
    shared = spark.sparkContext.broadcast((model.bucket, model.bias))  # BUCKETS floats

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*shared.value)
        for s in batches:
            z = np.fromiter((m.logit(t) for t in s), dtype=np.float64, count=len(s))
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels)
    held = F.coalesce(id_fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    model = fit(docs, labels)
    return docs.filter(score_column(docs.sparkSession, model, F.col("text")) >= THRESHOLD)
