"""Licence scans by a trained paragraph classifier (operator 3).

Paragraphs are the lines of a text.  A softmax regression over sparse word
n-grams (words and word pairs, hashed, averaged per paragraph) predicts the
licence family of a paragraph or ``unknown``.  It is trained by numpy gradient
descent on variants of the family templates (words dropped, swapped or put
around, numbers changed) against paragraphs of the corpus that hold no template
pair, from a bounded sample of documents.  The probability is calibrated by one
temperature, fitted on variants and paragraphs kept out of training, and
paragraphs below ``MIN_PROBABILITY`` are unknown.

A predicted paragraph is confirmed by comparison with the family's templates:
the share of a template's word pairs that the paragraph holds must reach
``MIN_OVERLAP`` for one of them.  Findings that are predicted but not confirmed
are reported with ``confirmed`` false.

Every paragraph of every whole text is scored.  Hashing, scoring and folding to
paragraphs work on the whole text's arrays, so the cost per word is constant.

*Windows.*  Lines that follow each other without a blank line are also read as
one run of words, and scored by windows of a template's length that begin at one
of its word pairs; so a statement is found inside a long line or wrapped over
lines.  Since the classifier knows whole paragraphs, a window counts only if it
holds ``WINDOW_OVERLAP`` of a template of the predicted family.  Of overlapping
windows of a family the best stays, with the number of the line it begins on; a
confirmed one replaces unconfirmed lines inside it, and no window is reported
from a line that says the same already.

Edge cases: NULL and empty texts and blank lines give nothing; repeated rows
and repeated lines are reported each; NULL ids are reported with NULL; an empty
table gives no rows (training then uses the templates alone); other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Documents sampled (in hash order) for paragraphs without a licence.
SAMPLE_DOCS = 400
#: Paragraphs taken from each of them at most, for training only.
SAMPLE_PARAGRAPHS = 20
VARIANTS = 60
EPOCHS = 60
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.8
#: Share of a template's word pairs that a window must hold.
WINDOW_OVERLAP = 0.5
#: Words more than its template's that a window may have.
WINDOW_SLACK = 2
#: Words of a text that are scored at a time (whole runs of lines).
_WORDS_AT_A_TIME = 1 << 16

# Short licence statements by family: fixed values.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "you may not use this file except in compliance with the License",
               "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 2.1"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Licensed under the BSD 3-Clause License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0.",
              "licensed under a Creative Commons Attribution 4.0 International License"],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file is strictly prohibited"],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?:\.\d+)*(?![^\W_])")


def words(paragraph: str) -> list[str]:
    """Lower-case words; numbers (versions, years) count as one word."""
    return _WORD.findall(_NUMBER.sub("0", paragraph.lower()))


def pairs(ws: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(ws, ws[1:])} or set(ws)


class Hashes(dict):
    """32-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh32_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def _pair_hash(h: np.ndarray) -> np.ndarray:
    return ((h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA6B) >> 16) % BUCKETS


def grams(ws: list[str]) -> np.ndarray:
    """Hashed words and word pairs of a paragraph."""
    h = np.array([xxhash.xxh32_intdigest(w) for w in ws], dtype=np.int64)
    return np.concatenate([h % BUCKETS, _pair_hash(h)])


def _variants(statement: str, fill: list[str], rng: np.random.Generator, count: int) -> list[list[str]]:
    base = words(statement)
    out = [base]
    for _ in range(count - 1):
        ws = [w for w in base if rng.random() > 0.06] or base
        ws = [fill[rng.integers(len(fill))] if fill and rng.random() < 0.04 else w for w in ws]
        if fill and rng.random() < 0.5:
            extra = [fill[rng.integers(len(fill))] for _ in range(rng.integers(1, 6))]
            ws = extra + ws if rng.random() < 0.5 else ws + extra
        out.append(ws)
    return out


class Model:
    """Weights (bucket by class), bias and calibration temperature."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray, temperature: float):
        self.weight, self.bias, self.temperature = weight, bias, temperature

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def train(ordinary: list[list[str]], seed: int = 11) -> Model:
    """Fit on template variants and ordinary paragraphs; every fifth example
    is kept for the temperature."""
    rng = np.random.default_rng(seed)
    fill = sorted({w for p in ordinary for w in p})
    data = [(v, FAMILIES.index(f)) for f in FAMILIES for t in TEMPLATES[f] for v in _variants(t, fill, rng, VARIANTS)]
    marks = {p for f in FAMILIES for t in TEMPLATES[f] for p in pairs(words(t))}
    data += [(p, UNKNOWN) for p in ordinary if p and marks.isdisjoint(pairs(p))]
    # Ordinary paragraphs made of template words in another order.
    loose = sorted({w for f in FAMILIES for t in TEMPLATES[f] for w in words(t)})
    data += [([loose[i] for i in rng.integers(len(loose), size=rng.integers(1, 7))], UNKNOWN) for _ in range(300)]
    order = rng.permutation(len(data))
    data = [(grams(data[i][0]), data[i][1]) for i in order]
    cut = len(data) // 5
    kept, learn = data[:cut], data[cut:]
    classes = len(FAMILIES) + 1
    weight, bias = np.zeros((BUCKETS, classes), np.float32), np.zeros(classes, np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(4.0 * (1 - epoch / EPOCHS) + 0.1)
        for k in rng.permutation(len(learn)):
            g, y = learn[k]
            z = weight[g].mean(axis=0) + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            np.add.at(weight, g, -rate * p / len(g))
            bias -= np.float32(0.02) * rate * p
    sums = np.array([weight[g].mean(axis=0) for g, _ in kept])
    goal = np.array([y for _, y in kept])
    best = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(
        np.maximum(Model(weight, bias, t).probabilities(sums)[np.arange(len(goal)), goal], 1e-12)).sum())
    return Model(weight, bias, best)


def fit(docs: DataFrame) -> Model:
    """Train with ordinary paragraphs of at most ``SAMPLE_DOCS`` documents."""
    ids = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, SAMPLE_PARAGRAPHS)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.struct(F.xxhash64("text").alias("h"), lines.alias("p")).alias("r"))
    # One text an id, however often the id is repeated.
    got = rows.groupBy("doc_id").agg(F.min("r").alias("r")).collect()
    return train([words(p) for r in sorted(got, key=lambda r: r["doc_id"]) for p in (r["r"]["p"] or [])])


class _Pairs:
    """Word pairs of all templates by their hashes."""

    def __init__(self):
        self.of = [(k, len(words(t)), pairs(words(t))) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
        every = sorted({p for _, _, ps in self.of for p in ps})
        key = np.array([self.join(*(np.array([xxhash.xxh32_intdigest(w)]) for w in p.split(" ")))[0] for p in every])
        order = np.argsort(key)
        self.key = key[order]
        self.held = np.array([[every[i] in ps for _, _, ps in self.of] for i in order])

    @staticmethod
    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


_PAIRS = _Pairs()


def _overlap(ws: list[str], family: int) -> float:
    """Largest share of a template's word pairs that the words hold."""
    own = pairs(ws)
    return max(len(own & ps) / len(ps) for k, _, ps in _PAIRS.of if k == family)


def _hash(lines: list[list[str]], known: Hashes) -> np.ndarray:
    return np.fromiter((known[w] for ws in lines for w in ws), np.int64, sum(map(len, lines)))


def _score_lines(lines: list[list[str]], h: np.ndarray, model: Model) -> np.ndarray:
    """Class probabilities of paragraphs with words, ``h`` being their hashes."""
    size = np.array([len(ws) for ws in lines])
    first = np.r_[0, np.cumsum(size)][:-1]
    both = np.zeros((len(h), len(model.bias)), np.float32)
    inner = np.ones(len(h), bool)
    inner[first] = False  # the pair ending at a paragraph's first word spans two
    both[1:] = model.weight[_pair_hash(h)]
    both *= inner[:, None]
    both += model.weight[h % BUCKETS]
    return model.probabilities(np.add.reduceat(both, first, axis=0) / (2 * size - 1)[:, None])


def _windows(h: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of the windows to score.  ``run``: the run of lines of
    each word, rising."""
    joined = _PAIRS.join(h[:-1], h[1:])
    at = np.minimum(np.searchsorted(_PAIRS.key, joined), len(_PAIRS.key) - 1)
    hits = np.flatnonzero((_PAIRS.key[at] == joined) & (run[:-1] == run[1:]))
    if not len(hits):
        return []
    held, last = _PAIRS.held[at[hits]], np.searchsorted(run, run[hits], side="right") - 2  # a run's last pair
    out = set()
    for t in np.flatnonzero(held.sum(axis=0) >= 1):
        _, n, ps = _PAIRS.of[t]
        mine = np.flatnonzero(held[:, t])
        starts = hits[mine]
        ends = np.searchsorted(starts, np.minimum(starts + n - 2 + WINDOW_SLACK, last[mine]), side="right")
        good = np.flatnonzero(ends - np.arange(len(starts)) >= WINDOW_OVERLAP * len(ps))
        out.update((int(starts[i]), int(starts[ends[i] - 1]) + 2) for i in good)
    return sorted(out)


def _found_in_windows(lines: list[list[str]], h: np.ndarray, run: np.ndarray, model: Model) -> list[tuple[int, int, int, float, float]]:
    """(first word, end, family, probability, overlap) of the best windows."""
    spans = _windows(h, run) if len(h) > 1 else []
    if not spans:
        return []
    flat = [w for ws in lines for w in ws]
    texts = [flat[a:b] for a, b in spans]
    prob = _score_lines(texts, np.concatenate([h[a:b] for a, b in spans]), model)
    best = []
    for i in np.flatnonzero(prob[:, :UNKNOWN].max(axis=1) >= MIN_PROBABILITY):
        k = int(prob[i, :UNKNOWN].argmax())
        overlap = _overlap(texts[i], k)
        if overlap >= WINDOW_OVERLAP:
            best.append((*spans[i], k, float(prob[i, k]), overlap))
    # Best first, by family; windows that overlap a better one go.
    taken: list[tuple[int, int, int, float, float]] = []
    used: set[tuple[int, int]] = set()
    for w in sorted(best, key=lambda w: (-w[4], -w[3], w[0])):
        cells = {(w[2], i) for i in range(w[0], w[1])}
        if used.isdisjoint(cells):
            used |= cells
            taken.append(w)
    return sorted(taken)


def scan_text(text: str | None, model: Model, known: Hashes) -> list[tuple[int, str, float, float, bool]]:
    """(paragraph number, family, probability, template overlap, confirmed)."""
    out = []
    numbers: list[int] = []
    lines: list[list[str]] = []
    runs: list[int] = []
    held = 0

    def finish():
        if not lines:
            return
        h = _hash(lines, known)
        prob = _score_lines(lines, h, model)
        rows: dict[int, tuple] = {}  # by line
        for i in np.flatnonzero(prob[:, :UNKNOWN].max(axis=1) >= MIN_PROBABILITY):
            k = int(prob[i, :UNKNOWN].argmax())
            overlap = _overlap(lines[i], k)
            rows[int(i)] = (numbers[i], FAMILIES[k], float(prob[i, k]), overlap, overlap >= MIN_OVERLAP)
        size = np.array([len(ws) for ws in lines])
        end = np.cumsum(size)
        more = []
        for a, b, k, p, overlap in _found_in_windows(lines, h, np.repeat(runs, size), model):
            span = range(int(np.searchsorted(end, a, side="right")), int(np.searchsorted(end, b - 1, side="right")) + 1)
            sure = overlap >= MIN_OVERLAP
            if any(i in rows and rows[i][1] == FAMILIES[k] and (rows[i][4] or not sure) for i in span):
                continue
            if sure:
                for i in span:
                    inside = a <= end[i] - size[i] and end[i] <= b
                    if i in rows and not rows[i][4] and (inside or rows[i][1] == FAMILIES[k]):
                        del rows[i]
            more.append((numbers[span[0]], FAMILIES[k], p, overlap, sure))
        out.extend(sorted([*rows.values(), *more], key=lambda r: r[0]))
        numbers.clear()
        lines.clear()
        runs.clear()

    run = 0
    for number, line in enumerate((text or "").split("\n")):
        ws = words(line)
        if ws:
            numbers.append(number)
            lines.append(ws)
            runs.append(run)
            held += len(ws)
        elif not line.strip():
            run += 1
            if held > _WORDS_AT_A_TIME:
                finish()
                held = 0
    finish()
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, overlap, confirmed): the
    paragraphs predicted to be a licence."""
    model = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.temperature))  # BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = Model(*sent.value), Hashes()
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                for f in scan_text(t.as_py(), m, known):
                    at.append(i)
                    found.append(f)
            cols = list(zip(*found)) if found else [[]] * 5
            kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "paragraph", "family", "probability", "overlap", "confirmed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, paragraph int, family string, probability double, overlap double, confirmed boolean")
