"""Toxicity by compression distance (operator 12).

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A text is cut into windows of ``WORDS`` words, ``STEP`` apart, and each window
is compressed with both; the bytes that the toxic dictionary saves say how much
of the window is told by toxic text alone.  Calibrated thresholds turn the
savings into a probability: the shares of windows that save at least 1, 2, ...
bytes enter a logistic function fitted on labelled rows that trained neither
dictionary.

Training samples are words with their document counts, counted by Spark over a
bounded sample of labelled rows (``SAMPLE_PER_CLASS`` of each class; copies and
near copies once, so that a group of them cannot pass for a common word).  The ordinary dictionary learns the commonest ordinary words.  The
toxic one holds the same content, followed by a dictionary trained on words
that at least ``LEAST_TEXTS`` toxic texts hold and that are ``CONTRAST`` times commoner
there; for a window without such words both lengths agree.  Every window is
preceded by the same few bytes of the ordinary dictionary, since zstandard
leaves an input uncompressed that it cannot shorten by three bytes.

Edge cases: NULL, empty and blank texts have no windows and get the logistic's
intercept; texts are read whole, a chunk of windows at a time; NULL labels are
left out; several labels of one id count as 1 if any is 1; with one class only,
or none, every score is the share of label 1 (0.5 without labels); repeated rows
are scored each; a NULL ``doc_id`` is scored and not held out; other columns are
ignored.  Words of over ``WORD_BYTES`` bytes are compressed like all others but
train no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospect.llm.common import id_fold, let, table_columns, words_of
from prospect.session import materialize

WORDS, STEP = 6, 3
#: Bound of the labelled sample, per class (rows are taken in hash order).
SAMPLE_PER_CLASS = 3000
#: Remainders of crc32(doc_id): held out; kept for calibration; the others train the dictionaries.
HELD_FOLD, CALIBRATION_FOLD, FOLDS = 0, 4, 5
THRESHOLD = 0.5
CONTRAST = 20.0
#: Shingle length and number of minimum hashes by which near copies in the sample are told.
COPY_SHINGLE, COPY_HASHES = 3, 8
ORDINARY_BYTES, TOXIC_BYTES, PRIMER_BYTES = 16 << 10, 1 << 10, 64
#: Segment lengths of dictionary training; toxic passages are short.
ORDINARY_SEGMENT, TOXIC_SEGMENT = 32, 16
#: Fewest toxic texts that hold a word marking them.
LEAST_TEXTS = 3
ORDINARY_WORDS, TOXIC_WORDS, WORD_BYTES = 8192, 128, 64
#: Savings, in bytes, whose shares are the features.
SAVINGS = tuple(range(1, 11))
#: Windows compressed in one call.
CHUNK = 16_384


def train_dictionary(words: list[tuple[str, int]], size: int, segment: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes for words with counts;
    the words themselves, commonest last, where they are too few to train on."""
    spelled = [(f" {w} ".encode("utf-8", "surrogatepass"), n) for w, n in words]
    samples = [w for w, n in spelled for _ in range(min(n, 20))]
    np.random.default_rng(1).shuffle(samples)
    joined = [b"".join(samples[at:at + 8]) for at in range(0, len(samples), 8)]
    try:
        return zstd.train_dictionary(size, joined, k=segment, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(w for w, _ in sorted(spelled, key=lambda x: (x[1], x[0])))[-size:]


def with_all(trained: bytes, words: list[tuple[str, int]]) -> bytes:
    """``trained`` followed by the words that training left out, commonest last."""
    spelled = [f" {w} ".encode("utf-8", "surrogatepass") for w, _ in sorted(words, key=lambda x: (x[1], x[0]))]
    return trained + b"".join(w for w in spelled if w not in trained)


def compressor(content: bytes) -> zstd.ZstdCompressor | None:
    """Compressor of short inputs against ``content`` (None if it is empty)."""
    if len(content) < 8:
        return None
    shared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    how = zstd.ZstdCompressionParameters.from_level(
        12, dict_size=len(content), source_size=32, strategy=zstd.STRATEGY_LAZY2, min_match=6,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    shared.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=shared, compression_params=how)


def lengths(by: zstd.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    """Compressed length of each window."""
    size = np.fromiter(map(len, windows), np.uint64, len(windows))
    segments = np.stack([np.cumsum(size) - size, size], axis=1).astype(np.uint64)
    packed = by.multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(windows), segments.tobytes()), threads=1)
    return np.fromiter(map(len, packed), np.int64, len(windows))


class Distance:
    """Savings of texts between an ordinary and a toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.primer = ordinary[len(ordinary) // 2:][:PRIMER_BYTES]
        self.ordinary, self.toxic = compressor(ordinary), compressor(ordinary + toxic) if toxic else None

    def windows(self, text: str | None) -> Iterator[bytes]:
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        for at in range(0, max(len(words) - WORDS + STEP, STEP if words else 0), STEP):
            yield b"%b %b " % (self.primer, b" ".join(words[at:at + WORDS]))

    def shares(self, texts: Iterator[str | None]) -> np.ndarray:
        """One row a text: the share of windows saving at least each of ``SAVINGS``."""
        texts = list(texts)
        hits, count = np.zeros((len(texts), len(SAVINGS))), np.zeros(len(texts))
        if self.ordinary is None or self.toxic is None:
            return hits
        held: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            saved = lengths(self.ordinary, held) - lengths(self.toxic, held)
            whose = np.asarray(owner)
            count[:] += np.bincount(whose, minlength=len(texts))
            for k, least in enumerate(SAVINGS):
                hits[:, k] += np.bincount(whose[saved >= least], minlength=len(texts))
            held.clear()
            owner.clear()

        for row, text in enumerate(texts):
            for window in self.windows(text):
                held.append(window)
                owner.append(row)
                if len(held) >= CHUNK:
                    flush()
        if held:
            flush()
        return hits / np.maximum(count, 1)[:, None]


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the logistic function of the root shares."""

    ordinary: bytes
    toxic: bytes
    bias: float
    weight: tuple[float, ...]

    def probability(self, shares: np.ndarray) -> np.ndarray:
        z = self.bias + np.sqrt(shares) @ np.asarray(self.weight)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, tuple[float, ...]]:
    """Bias and weights by Newton's steps, lightly ridged."""
    full = np.column_stack([np.ones(len(x)), x])
    pull = np.full(full.shape[1], ridge * len(y) + 1e-6)
    w = np.zeros(full.shape[1])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + pull * w
        curve = (full * (p * (1 - p))[:, None]).T @ full + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def labelled_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """(id, label): at most ``per_class`` labelled ids of each class outside the
    held-out fold, in hash order so that the choice ignores row order."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).dropna()
             .filter(id_fold(F.col("id"), FOLDS) != HELD_FOLD).groupBy("id").agg(F.max("label").alias("label")))
    return known.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(per_class).unionByName(
        known.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(per_class))


def one_of_copies(texts: DataFrame) -> DataFrame:
    """``texts`` (label, calibrates, text) without exact copies and without texts
    that share a minimum hash of word shingles with a smaller one of their class."""
    def seeded(k: int):
        return lambda shingle: F.xxhash64(F.lit(k), shingle)

    def minima(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - COPY_SHINGLE + 1, F.lit(1)))
        shingles = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, COPY_SHINGLE)))
        return let(shingles, lambda all_: F.array(*(F.array_min(F.transform(all_, seeded(k))) for k in range(COPY_HASHES))))

    signed = (texts.dropDuplicates(["label", "text"])
              .select("*", let(words_of(F.lower("text")), minima).alias("minima"), F.struct(F.xxhash64("text"), "text").alias("own")))
    for k in range(COPY_HASHES):
        signed = signed.withColumn(f"first{k}", F.min("own").over(Window.partitionBy("label", F.col("minima")[k])))
    first = [F.col("own") == F.col(f"first{k}") for k in range(COPY_HASHES)]
    return signed.filter(reduce(Column.__and__, first)).select("label", "calibrates", "text")


def word_counts(texts: DataFrame) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Commonest ordinary words, and the words that mark toxic texts, each with
    the number of its texts; both bounded in rows and bytes."""
    total = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    word = F.explode(F.array_distinct(words_of(F.lower("text")))).alias("word")
    counts = (texts.select("label", word).filter(F.octet_length("word") <= WORD_BYTES).groupBy("word")
              .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")))
    ordinary = counts.filter("n0 > 0").orderBy(F.desc("n0"), "word").limit(ORDINARY_WORDS).collect()
    often = F.col("n1") * F.lit(float(n0)) >= F.lit(CONTRAST * max(n1, 1)) * (F.col("n0") + F.lit(0.5))
    toxic = counts.filter((F.col("n1") >= LEAST_TEXTS) & often).orderBy(F.desc("n1"), "word").limit(TOXIC_WORDS).collect()
    return [(r["word"], r["n0"]) for r in ordinary], [(r["word"], r["n1"]) for r in toxic]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Train both dictionaries and calibrate; only words with counts and rows of
    ``SAVINGS`` shares reach the driver."""
    spark = docs.sparkSession
    sample = F.broadcast(labelled_sample(labels, per_class))  # at most 2 * per_class ids
    texts = (table_columns(docs, "doc_id", "text").join(sample, F.col("doc_id") == F.col("id"))
             .select("label", (id_fold(F.col("id"), FOLDS) == CALIBRATION_FOLD).alias("calibrates"), F.coalesce("text", F.lit("")).alias("text")))
    texts = materialize(one_of_copies(texts), "toxicity-sample")
    ordinary, toxic = word_counts(texts.filter("NOT calibrates"))
    base = train_dictionary(ordinary, ORDINARY_BYTES, ORDINARY_SEGMENT)
    marks = with_all(train_dictionary(toxic, TOXIC_BYTES, TOXIC_SEGMENT), toxic) if toxic else b""
    rows = texts.filter("calibrates").select("label", shares_column(spark, base, marks, F.col("text")).alias("x")).collect()
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("y")).dropna().filter(id_fold(F.col("doc_id"), FOLDS) != HELD_FOLD)
    share = known.agg(F.avg("y")).first()[0]
    y = np.array([r["label"] for r in rows], float)
    if not marks or len(y) == 0 or y.min() == y.max():
        p = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return Model(base, b"", float(np.log(p / (1 - p))), (0.0,) * len(SAVINGS))
    bias, weight = fit_logistic(np.sqrt(np.array([r["x"] for r in rows], float)), y)
    # The sample may be balanced by class; move the bias back to the labels' share.
    if share is not None and 0 < share < 1:
        bias += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return Model(base, marks, bias, weight)


def shares_column(spark: SparkSession, ordinary: bytes, toxic: bytes, text: Column) -> Column:
    """Shares of windows by savings of each text, as an array."""
    shared = spark.sparkContext.broadcast((ordinary, toxic))  # 20 KB and at most TOXIC_WORDS words

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance(*shared.value)
        for s in batches:
            yield pd.Series(list(distance.shares(s)))

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        distance = Distance(m.ordinary, m.toxic)
        for s in batches:
            yield pd.Series(m.probability(distance.shares(s)))

    held = F.coalesce(id_fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    scored = table_columns(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
