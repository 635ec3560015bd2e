"""Toxicity: held-out accuracy, and its parts against plain counts."""

import random

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from prospect.llm import toxicity

pytestmark = pytest.mark.filterwarnings("ignore")
INSULTS = ["dreckskerl", "vollpfosten", "blockhead", "nitwit", "dunderhead", "halunke"]


def prose(rng, n, insults=0):
    syllables = ["an", "ther", "ing", "lo", "mer", "ti", "ous", "be", "ver", "sta", "den", "ol"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(insults):
        words[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(words)


def corpus(spark, n=700):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(40, 160), 4 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t, _ in rows], "doc_id long, text string, label int, n0 string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_documents_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(truth) and [f.name for f in toxicity.score_documents(docs, labels).schema][:4] == ["doc_id", "held_out", "score", "predicted"]
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_held_out_labels_are_never_learned(spark):
    docs, labels, _ = corpus(spark, 400)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    flipped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.ordinary, a.toxic, a.weight, a.bias) == (b.ordinary, b.toxic, b.weight, b.bias)


def test_odd_texts_and_tables(spark):
    docs, labels, _ = corpus(spark, 300)
    odd = [None, "", " \n\t ", "x", "w " * 50_000, "x" * 200_000, "nitwit " * 30, "nitwit " * 30]
    more = docs.limit(0).unionByName(spark.createDataFrame([(None if k == 7 else 9000 + k, t, 0, "x") for k, t in enumerate(odd)], docs.schema))
    rows = toxicity.score_documents(docs.unionByName(more), labels).filter("doc_id >= 9000 OR doc_id IS NULL").collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8 and by[9000]["score"] == by[9001]["score"] == by[9002]["score"] and by[9006]["predicted"] == 1
    assert by[None]["held_out"] is False and by[None]["score"] == by[9006]["score"]
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    # One class, or no label at all: the share of label 1.
    clean = toxicity.score_documents(docs, labels.withColumn("toxic", F.lit(0))).collect()
    assert {round(r["score"], 4) for r in clean} == {0.0} and {r["predicted"] for r in clean} == {0}
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_copies_do_not_make_words_common(spark):
    rng = random.Random(1)
    base = prose(rng, 300).split()
    near = [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in range(0, 300, 10)]
    rows = [(1, False, t) for t in near] + [(1, False, near[0])] + [(1, False, prose(rng, 50)) for _ in range(5)]
    kept = toxicity.one_of_copies(spark.createDataFrame(rows, "label int, calibrates boolean, text string")).collect()
    assert 6 <= len(kept) <= 9 and {"label", "calibrates", "text"} == set(kept[0].asDict())


def test_savings_equal_single_compressions():
    rng = random.Random(3)
    ordinary = toxicity.train_dictionary([(w, 5) for w in set(prose(rng, 2000).split())], toxicity.ORDINARY_BYTES, toxicity.ORDINARY_SEGMENT)
    toxic = toxicity.with_all(b"", [(w, 9) for w in INSULTS])
    d = toxicity.Distance(ordinary, toxic)
    text = prose(rng, 40, 5)
    saved = []
    for window in d.windows(text):
        assert window.startswith(d.primer)
        saved.append(len(d.ordinary.compress(window)) - len(d.toxic.compress(window)))
    assert len(saved) == -(-(40 - toxicity.WORDS) // toxicity.STEP) + 1
    assert d.shares([text])[0].tolist() == [np.mean([s >= k for s in saved]) for k in toxicity.SAVINGS]
    assert isinstance(d.toxic, zstd.ZstdCompressor)


def test_the_logistic_fit_is_a_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -2, 0] + 0.3)))).astype(float)
    bias, weight = toxicity.fit_logistic(x, y)

    def loss(v):
        z = v[0] + x @ v[1:]
        return np.sum(np.log1p(np.exp(z)) - y * z) + 0.5 * (1e-4 * 300 + 1e-6) * v @ v

    at = np.array([bias, *weight])
    assert all(loss(at) <= loss(at + e) for e in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3)
