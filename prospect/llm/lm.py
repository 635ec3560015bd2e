"""Language-model scores of whole documents (operator 5).

Tokens are ASCII-lower-cased words plus one end per document.  Counts cover all
training documents.  The ``HEAD`` most frequent words are modelled one by one,
in classes of ``CLASS_WORDS`` words of similar frequency; every other word,
seen or not, belongs to one of ``TAIL`` classes by its shape (length, letters,
ending), inside which words have their smoothed unigram share.  A gated
recurrent network (GRU) predicts the class of the next token, and a second
softmax the word inside a head class:

    P(token | past) = P(class | state) * P(token | class, state)

which sums to one over all words, the unseen counting as one word per class.

*Training.*  The network starts at the unigram model (output biases are log
frequencies) and is improved by truncated backpropagation through time in
numpy.  All training documents are learned from, once each.  Texts are cut into
pieces of at most ``PIECE`` tokens, equal pieces are counted, and pieces are
dealt by a hash of their symbols to streams of about ``STREAM`` tokens, the
copies of one piece in turn to different streams: neither a very long text nor
a third of all rows being equal makes a stream longer, and streams depend on
neither files nor partitions.  Stream ``i`` is trained on in round ``i`` modulo
``ROUNDS``; parameters are averaged over the streams of a round by distributed
sums, weighted by tokens, between rounds.

*Scoring.*  Documents run side by side, longest first, the state carried from
window to window until the document ends.  Counts of at most ``KNOWN`` most
frequent words, chosen by a histogram of counts, travel to the tasks; rarer words
meet the whole count table by buckets of words, so no count is cut off.

Edge cases: NULL and empty texts are the end token alone; a NULL ``doc_id`` is
neither held out nor trained on apart (it counts as training); repeated rows
count and are scored each; without training documents every word has the same
probability; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospect.llm.common import id_fold
from prospect.session import materialize

HELD_FOLD, FOLDS = 1, 5
HEAD, CLASS_WORDS, TAIL = 2048, 32, 32
HEAD_CLASSES = HEAD // CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL
#: Words whose counts are sent to the tasks, and their longest in bytes; the
#: counts of all others are joined.
KNOWN, KNOWN_BYTES = 1 << 17, 256
EMBED, HIDDEN = 16, 24
ROUNDS = 2
#: Tokens of a training stream, on average.
STREAM = 1 << 19
#: Longest piece of a text inside a stream, and the mark beside a cut.
PIECE, CUT = 1 << 13, -1
#: Copies of a piece that one task deals.
DEALT = 1 << 12
#: Lanes at most, windows at least, tokens of a window a lane, learning rate.
LANES, WINDOWS, STEPS, RATE = 256, 50, 20, 0.03
SCORE_LANES, WINDOW = 2048, 1 << 13
#: The end token; it cannot be a word (it holds a space).
END = " "
#: Words counted at once by a task, rows and bytes of text in one go.
_FLUSH, _ROWS, _BYTES = 4_000_000, 400_000, 1 << 25
_LOG10 = float(np.log(10.0))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` (as ``tokens``) one after the other, and the
    number of words of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    size, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten()
    blank = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    if len(blank):  # white space at the ends of a text
        size = size - np.bincount(np.searchsorted(np.cumsum(size), blank, side="right"), minlength=len(size))
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, size.astype(np.int64)


def _parts(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of like size in column ``texts``, about ``_BYTES`` bytes
    at most."""
    size = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
    share = np.cumsum(size, dtype=np.int64)
    total = int(share[-1]) if len(share) else 0
    share //= -(-total // max(1, -(-total // _BYTES))) + 1
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def with_ends(words: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``words`` with ``end`` put after the ``size`` ones of each text, and
    where each text stops."""
    stop = np.cumsum(size + 1)
    out = np.full(len(words) + len(size), end, words.dtype)
    word = np.ones(len(out), bool)
    word[stop - 1] = False
    out[word] = words
    return out, stop


def _shape_class(size: int, plain: bool, end: int, letter: bool) -> int:
    return zlib.crc32(bytes((size, plain, end, letter))) % TAIL


_SHAPES = np.array([_shape_class(*x) for x in product(range(5), (False, True), range(3), (False, True))])
_ENDS = np.array([0 if bytes([x]).isalnum() or x >= 0x80 else 1 if x in b".,!" else 2 for x in range(256)])
_LETTERS = np.array([bytes([x]).isalpha() for x in range(256)])


def tail_classes(words: pa.Array) -> np.ndarray:
    """Shape class of each word (none is empty): length, kind of letters, kind
    of ending."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.searchsorted([1, 2, 4, 8], np.diff(at), side="right")
    wide = np.r_[0, np.cumsum(data[at[0]:at[-1]] >= 0x80, dtype=np.int64)]
    plain = wide[at[1:] - at[0]] == wide[at[:-1] - at[0]]
    return _SHAPES[((size * 2 + plain) * 3 + _ENDS[data[at[1:] - 1]]) * 2 + _LETTERS[data[at[:-1]]]]


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Place of each word among the known ones, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


# ------------------------------------------------------------------- counts

def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all documents, the end token included.  Words are
    counted inside each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out():
            count = pc.value_counts(pa.chunked_array(held))
            for lo in range(0, len(count), _ROWS):
                part = count.slice(lo, _ROWS).flatten()
                yield pa.RecordBatch.from_arrays([part[0].cast(pa.binary()), part[1]], names=["word", "c"])

        for batch in batches:
            for part in _parts(batch, 0):
                words, _ = split_words(part.column(0))
                held.append(words)
                size += len(words)
                ends += part.num_rows
                if size > _FLUSH:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode()]), pa.array([ends])], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_mass(counts: DataFrame) -> dict[int, float]:
    """Sum of (c + 0.5) of every word by shape class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(TAIL)
        for batch in batches:
            mass += np.bincount(tail_classes(batch.column(0)), batch.column(1).to_numpy() + 0.5, TAIL)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL, dtype=np.int32)), pa.array(mass)], names=["k", "m"])

    rows = counts.mapInArrow(run, "k int, m double").groupBy("k").agg(F.sum("m")).collect()  # TAIL rows
    return {r[0]: r[1] for r in rows}


class Vocabulary:
    """What tasks need of the counts: codes of known words.

    Code ``i < HEAD`` is a head word; other known words follow; an unknown
    word has code -1.  Symbols (network inputs) are head words
    and tail classes."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, mass: dict[int, float]):
        self.words, self.total, self.distinct = words, total, distinct
        self.known = pa.array(words, pa.binary())
        self.c = np.array(counts, dtype=np.float64)
        shapes, head = tail_classes(self.known), min(HEAD, len(words))
        tail = shapes[head:]
        lost = np.bincount(shapes[:head], self.c[:head] + 0.5, TAIL)
        # Mass of a tail class: its words outside the head and one unseen word.
        self.z = np.maximum(np.array([mass.get(k, 0.0) for k in range(TAIL)]) - lost, 0.0) + 0.5
        self.symbol = np.concatenate([np.arange(head), HEAD + tail]).astype(np.int64)
        self.base = np.log10((self.c + 0.5) / self.denominator) if total or words else self.c
        # log P(word | tail class); the network gives it for head words.
        inside = np.zeros(len(words))
        inside[head:] = np.log((self.c[head:] + 0.5) / self.z[tail])
        self.inside = inside
        at = words.index(END.encode()) if END.encode() in words else -1
        self.end = int(self.symbol[at]) if at >= 0 else HEAD

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def encode(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Code of each word, -1 for unknown ones."""
        return _codes(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()), self.known)


def _network(v: Vocabulary, seed: int = 3) -> list[np.ndarray]:
    """Parameters that start as the unigram model."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    head = np.full(HEAD, 1e-4)
    n = min(HEAD, len(v.words))
    head[:n] = v.c[:n] + 0.5
    per_class = head.reshape(HEAD_CLASSES, CLASS_WORDS)
    mass = np.concatenate([per_class.sum(axis=1), v.z])
    return [
        small(HEAD + TAIL, EMBED), small(EMBED, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32),
        np.zeros((HIDDEN, CLASSES), np.float32), np.log(mass / mass.sum()).astype(np.float32),
        np.zeros((HEAD_CLASSES, CLASS_WORDS, HIDDEN), np.float32),
        np.log(per_class / per_class.sum(axis=1, keepdims=True)).astype(np.float32),
    ]


def _sigmoid_of_negative(x: np.ndarray) -> None:
    """1 / (1 + exp(x)), in place; the exponential may overflow."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _exp_sums(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """In place exp(x - top); sums over the last axis but one, and ``top``.  It
    is 0 if ``weight``, by which states from -1 to 1 became ``x``, keeps all
    values far from the ends of the range of floats."""
    top = 0.0
    if not np.abs(weight).sum(axis=-1).max() < 60:
        top = x.max(axis=-2, keepdims=True)
        x -= top
    np.exp(x, out=x)
    return x.sum(axis=-2, keepdims=True), top


def _with_bias(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights whose last column meets a row of ones."""
    return np.concatenate([weight, bias[..., None]], axis=-1)


def _recurrent(p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of inputs (with bias) and of states, by rows of gates; those of
    the two sigmoid gates are negated."""
    sign = np.where(np.arange(3 * HIDDEN) < 2 * HIDDEN, -1, 1).astype(p[0].dtype)[:, None]
    return sign * _with_bias(p[1].T, p[3]), sign * p[2].T


def _class_of(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol < HEAD, symbol // CLASS_WORDS, HEAD_CLASSES + symbol - HEAD)


def train_network(p: list[np.ndarray], stream: np.ndarray, end: int) -> list[np.ndarray]:
    """One pass of truncated backpropagation over a stream of symbols, dealt
    to lanes side by side.  The state is reset where a document ends and at a
    ``CUT``, whose neighbours are not learned from each other."""
    lanes = int(min(LANES, max(1, len(stream) // (WINDOWS * STEPS))))
    size = len(stream) // lanes
    if size < 2:
        return p
    data = np.ascontiguousarray(stream[:lanes * size].reshape(lanes, size).T)
    flat = _pack(p)
    p = _unpack(flat, p)  # views, so the updates reach them
    mean, var = np.zeros_like(flat), np.zeros_like(flat)
    h = np.zeros((lanes, HIDDEN), np.float32)
    windows = range(0, size - 1, STEPS)
    for number, at in enumerate(windows, 1):
        target = data[at + 1:at + STEPS + 1]
        with np.errstate(over="ignore"):
            grad, h, learned = _gradient(p, data[at:at + len(target)], target, h, end)
        x = _pack(grad)
        scale = 1.0 / max(1, learned)
        norm = scale * np.sqrt(float(np.vdot(x, x)))
        x *= np.float32(scale * min(1.0, 1.0 / max(norm, 1e-9)))
        rate = RATE * (1 - 0.8 * number / (len(windows) + 1)) / (1 - 0.9 ** number)
        mean += np.float32(0.1) * (x - mean)
        x *= x
        x -= var
        x *= np.float32(0.01)
        var += x
        np.sqrt(np.multiply(var, np.float32(1 / (1 - 0.99 ** number)), out=x), out=x)
        x += np.float32(1e-6)
        np.divide(mean, x, out=x)
        x *= np.float32(rate)
        flat -= x
    return p


def _gradient(p: list[np.ndarray], inp: np.ndarray, target: np.ndarray, h: np.ndarray, end: int) -> tuple:
    """Gradient of the summed negative log-probability of ``target`` (steps x
    lanes), the state after it, and the number of symbols learned from.
    Arrays inside are steps x values x lanes."""
    emb, wx, u, b, wc, bc, ww, bw = p
    steps, lanes = inp.shape
    n = HIDDEN
    cut = inp == CUT
    symbol = np.where(cut, end, inp)
    keep = (symbol != end).astype(np.float32)
    of_input, of_state = _recurrent(p)
    turned = lambda x: x.transpose(0, 2, 1)
    space = lambda k: np.empty((steps, k, lanes), np.float32)
    seen, states = space(EMBED + 1), space(n + 1)
    seen[:, :EMBED], seen[:, EMBED], states[:, n] = emb.T.take(symbol, axis=1, mode="clip").transpose(1, 0, 2), 1, 1
    x = of_input @ seen
    prev, cand, rec = space(n), space(n), space(3 * n)
    h = h.T
    for t in range(steps):
        r = np.matmul(of_state, np.multiply(h, keep[t], out=prev[t]), out=rec[t])
        g = x[t, :2 * n]
        g += r[:2 * n]
        _sigmoid_of_negative(g)
        c = np.multiply(g[n:], r[2 * n:], out=cand[t])
        c += x[t, 2 * n:]
        np.tanh(c, out=c)
        h = np.subtract(prev[t], c, out=states[t, :n])
        h *= g[:n]
        h += c
    # From here to the way back: values x tokens.
    flat, goal, skip = states.transpose(1, 0, 2).reshape(n + 1, -1), target.reshape(-1), ((target == CUT) | cut).reshape(-1)
    cls = np.where(skip, CLASSES, _class_of(goal)).astype(np.int16)
    classes, words = _with_bias(wc.T, bc), _with_bias(ww, bw)
    prob = classes @ flat
    prob *= 1 / _exp_sums(prob, classes)[0]
    rows = np.flatnonzero(~skip)
    if len(rows) < len(skip):
        prob[:, skip] = 0
    prob[cls[rows], rows] -= 1
    into, dclass = wc @ prob, prob @ flat.T
    # Words inside head classes, in order of class.
    by = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[by], np.arange(HEAD_CLASSES + 1))
    by = by[:cuts[-1]]
    spans = [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts)).tolist()]
    inside = flat.take(by, axis=1)
    inner = np.empty((CLASS_WORDS, len(by)), np.float32)
    for k, at in spans:
        np.matmul(words[k], inside[:, at], out=inner[:, at])
    inner *= 1 / _exp_sums(inner, words)[0]
    inner[goal[by] % CLASS_WORDS, np.arange(len(by))] -= 1
    back, dwords = np.zeros((n, len(by) + 1), np.float32), np.zeros_like(words)
    for k, at in spans:
        np.matmul(inner[:, at], inside[:, at].T, out=dwords[k])
        np.matmul(ww[k].T, inner[:, at], out=back[:, at])
    place = np.full(len(cls), len(by))
    place[by] = np.arange(len(by))
    into += back.take(place, axis=1)
    into = np.ascontiguousarray(into.reshape(n, steps, lanes).transpose(1, 0, 2))
    # Factors of all steps at once, then back through time.
    z, g = x[:, :n], x[:, n:2 * n]
    rest = 1 - z
    fz = prev - cand
    fz *= z
    fz *= rest
    fc = np.multiply(cand, cand, out=cand)
    np.subtract(1, fc, out=fc)
    fc *= rest
    fg = np.multiply(rec[:, 2 * n:], g)
    fg *= np.subtract(1, g, out=rest)
    # Rows: candidate as the state meets it, both gates, candidate.
    d, order = space(4 * n), np.r_[2 * n:3 * n, :2 * n]
    back_state = np.ascontiguousarray(u[:, order])
    dh = np.zeros((n, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        dh += into[t]
        np.multiply(dh, fz[t], out=d[t, n:2 * n])
        dc = np.multiply(dh, fc[t], out=d[t, 3 * n:])
        np.multiply(dc, fg[t], out=d[t, 2 * n:3 * n])
        np.multiply(dc, g[t], out=d[t, :n])
        dh *= z[t]
        dh += back_state @ d[t, :3 * n]
        dh *= keep[t]
    du = np.empty_like(u)
    du[:, order] = (prev @ turned(d[:, :3 * n])).sum(axis=0)
    dinput = (seen @ turned(d[:, n:])).sum(axis=0)
    # Sums by symbol and column.
    cell = symbol[:, None] * EMBED + np.arange(EMBED)[:, None]
    demb = np.bincount(cell.reshape(-1), (wx @ d[:, n:]).reshape(-1), emb.size).reshape(emb.shape)
    grad = [demb, dinput[:EMBED], du, dinput[EMBED], dclass[:, :n].T, dclass[:, n], dwords[:, :, :n], dwords[:, :, n]]
    return grad, h.T, len(rows)


def score_batch(p: list[np.ndarray], v: Vocabulary, docs: list[np.ndarray], symbols: list[np.ndarray]) -> np.ndarray:
    """Natural-log probability of each document's codes (end last), without
    the share of unknown words inside their tail class."""
    emb, wx, u, b, wc, bc, ww, bw = p
    n, end = HIDDEN, v.end
    of_input, of_state = _recurrent(p)
    table = of_input @ np.concatenate([emb.T, np.ones((1, len(emb)), emb.dtype)])
    classes, words = _with_bias(wc.T, bc), _with_bias(ww, bw)
    out = np.zeros(len(docs))
    length = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-length, kind="stable")

    def window(states: list, goals: np.ndarray) -> np.ndarray:
        """Log-probability of every goal."""
        flat = np.ones((n + 1, len(goals)), np.float32)
        np.concatenate(states, axis=1, out=flat[:n])
        cls = _class_of(goals).astype(np.int16)
        logits = classes @ flat
        logp = logits[cls, np.arange(len(goals))]
        total, top = _exp_sums(logits, classes)
        logp -= (np.log(total) + top)[0]
        by = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[by], np.arange(HEAD_CLASSES + 1))
        by = by[:cuts[-1]]
        inside, inner = flat.take(by, axis=1), np.empty((CLASS_WORDS, len(by)), np.float32)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            at = slice(cuts[k], cuts[k + 1])
            np.matmul(words[k], inside[:, at], out=inner[:, at])
        found = inner[goals[by] % CLASS_WORDS, np.arange(len(by))]
        total, top = _exp_sums(inner, words)
        logp[by] += found - (np.log(total) + top)[0]
        return logp

    for first in range(0, len(order), SCORE_LANES):
        lanes = order[first:first + SCORE_LANES]
        many = length[lanes]
        # Lanes longer than t, for every t, and symbols step by step.
        alive = np.searchsorted(-many, -np.arange(many[0]), side="left")
        begin = np.r_[0, np.cumsum(alive)]
        lane = np.repeat(np.arange(len(lanes), dtype=np.int32), many)
        place = begin[np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many)] + lane
        goals, owner = np.empty(len(lane), np.int16), np.empty(len(lane), np.int32)
        goals[place], owner[place] = np.concatenate([symbols[i] for i in lanes]), lane
        logp = np.empty(len(lane), np.float32)
        h = np.zeros((n, len(lanes)), np.float32)
        prev = np.full(len(lanes), end)
        states, done = [], 0
        for m, at in zip(alive.tolist(), begin.tolist()):
            h = h[:, :m]
            x, r = table.take(prev[:m], axis=1, mode="clip"), of_state @ h
            g, c = x[:2 * n], x[2 * n:]
            g += r[:2 * n]
            _sigmoid_of_negative(g)
            r = r[2 * n:]
            r *= g[n:]
            c += r
            np.tanh(c, out=c)
            h = h - c
            h *= g[:n]
            h += c
            prev = goals[at:at + m]
            states.append(h)
            if at + m - done >= WINDOW or at + m == len(goals):
                logp[done:at + m] = window(states, goals[done:at + m])
                states, done = [], at + m
        out[lanes] = np.bincount(owner, logp, len(lanes))
    return out


# -------------------------------------------------------------------- Spark

def _vocabulary(counts: DataFrame) -> tuple:
    """At most ``KNOWN`` most frequent words of at most ``KNOWN_BYTES`` bytes,
    their counts, all tokens, distinct words and the mass of tail classes."""
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    short = counts.filter(F.length("word") <= KNOWN_BYTES).withColumn("bin", F.floor(F.log2("c") * 16).cast("int"))
    least, held = 1 << 30, 0
    for k, n in sorted(map(tuple, short.groupBy("bin").count().collect()), reverse=True):  # at most 16 x 64 rows
        held += n
        if held > KNOWN:
            break
        least = k
    top = short.filter(F.col("bin") >= least).select("word", "c").toArrow()  # bounded by KNOWN
    rows = sorted(zip(map(bytes, top.column("word").to_pylist()), top.column("c").to_pylist()), key=lambda r: (-r[1], r[0]))
    return [w for w, _ in rows], [c for _, c in rows], int(total or 0), int(distinct), tail_mass(counts)


def _pack(p: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in p]).astype(np.float32)


def _unpack(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for a in like:
        out.append(flat[at:at + a.size].reshape(a.shape))
        at += a.size
    return out


def training_streams(docs: DataFrame, known: tuple) -> tuple[DataFrame, int]:
    """(stream int, place long, copies long, symbols binary): the pieces of every
    row of ``docs``, equal ones together, and the number of streams."""
    words = docs.sparkSession.sparkContext.broadcast(known[0][:HEAD])
    streams = max(1, -(-known[2] // STREAM))
    mark = np.array([CUT], "<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(words.value, pa.binary())
        end = words.value.index(END.encode()) if END.encode() in words.value else HEAD
        for batch in batches:
            for part in _parts(batch, 0):
                flat, size = split_words(part.column(0))
                flat = flat.dictionary_encode()
                each = flat.dictionary.cast(pa.binary())
                code = _codes(each, head)
                symbol = np.where(code < 0, HEAD + tail_classes(each), code).astype("<i2")
                data, stop = with_ends(symbol[flat.indices.to_numpy()], size, end)
                data, out = data.tobytes(), []
                for lo, hi in zip((2 * (stop - size - 1)).tolist(), (2 * stop).tolist()):
                    cuts = range(lo, hi, 2 * PIECE)
                    out += [mark * (k > lo) + data[k:min(hi, k + 2 * PIECE)] + mark * (k < cuts[-1]) for k in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["symbols"])

    pieces = docs.select("text").mapInArrow(run, "symbols binary").groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))
    pieces = materialize(pieces.select(F.xxhash64("symbols").alias("place"), "n", "symbols"), "lm-pieces")
    # Each of n copies goes to the next stream in turn, so min(n, streams) rows
    # stand for them; a piece with very many is dealt by several tasks.
    number = F.lit(streams).cast("long")
    wide = pieces.withColumn("rows", F.least("n", number))
    few = wide.filter(F.col("rows") <= DEALT).withColumn("lo", F.lit(0).cast("long"))
    many = wide.filter(F.col("rows") > DEALT).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(DEALT).cast("long"))))
    shares = few if streams <= DEALT else few.unionByName(many.repartition("place", "lo"))
    shares = shares.withColumn("s", F.explode(F.sequence("lo", F.least(F.col("rows"), F.col("lo") + DEALT) - 1)))
    stream = F.pmod(F.pmod("place", number) + F.col("s"), number).cast("int").alias("stream")
    copies = (F.floor(F.col("n") / number) + (F.col("s") < F.col("n") % number).cast("long")).alias("copies")
    return shares.select(stream, "place", copies, "symbols"), streams


def fit(docs: DataFrame, known: tuple) -> np.ndarray:
    """Packed parameters after ``ROUNDS`` rounds of averaged training over
    ``docs`` (training documents)."""
    spark = docs.sparkSession
    like = _network(Vocabulary(*known))
    flat = _pack(like)
    shapes = [a.shape for a in like]
    code_of_end = next((i for i, w in enumerate(known[0][:HEAD]) if w == END.encode()), HEAD)
    piece = 4096
    dealt, streams = training_streams(docs, known)
    # One task a stream, as long as that is not too many tasks.
    tasks = min(-(-streams // ROUNDS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-streams // 64)))

    for number in range(min(ROUNDS, streams)):
        sent = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = _unpack(sent.value, [np.empty(s, np.float32) for s in shapes])
            weighed, seen = np.zeros(len(sent.value)), 0
            stream, held = None, []

            def learn():
                nonlocal weighed, seen
                data = np.frombuffer(b"".join(held), "<i2").astype(np.int64)
                weighed += _pack(train_network(start, data, code_of_end)).astype(np.float64) * len(data)
                seen += len(data)
                held.clear()

            for batch in batches:
                for k, n, row in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != stream and held:
                        learn()
                    stream = k
                    held += [row] * n
            if held:
                learn()
            if not seen:
                return
            for k in range(0, len(weighed), piece):
                yield pa.RecordBatch.from_arrays([pa.array([k // piece], pa.int32()), pa.array([float(seen)]),
                                                  pa.array([weighed[k:k + piece].tobytes()], pa.binary())], names=["k", "w", "part"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in rows["part"])
            return pd.DataFrame({"k": rows["k"].iloc[:1], "w": [rows["w"].sum()], "part": [total.tobytes()]})

        schema = "k int, w double, part binary"
        mine = dealt.filter(F.col("stream") % ROUNDS == number)
        mine = mine.repartitionById(tasks, F.floor(F.col("stream") / ROUNDS).cast("int")).sortWithinPartitions("stream", "place", "symbols")
        parts = mine.select("stream", "copies", "symbols").mapInArrow(run, schema)
        # Two levels of sums, so no group holds more than a share of the tasks.
        half = parts.groupBy("k", F.pmod(F.spark_partition_id(), F.lit(32)).alias("s")).applyInPandas(add, schema)
        rows = half.groupBy("k").applyInPandas(add, schema).orderBy("k").collect()  # one network
        if rows:
            flat = np.concatenate([np.frombuffer(r["part"]) / r["w"] for r in rows]).astype(np.float32)
    return flat


_SCORED = ("kind int, ref long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, logp double, "
           "bucket int, words array<binary>, rows array<int>, refs array<long>, times array<long>")


def _rare_words(words: pa.Array, word: np.ndarray, ref: np.ndarray, times: np.ndarray, buckets: int) -> list[pa.Array]:
    """A row a bucket of words: the words, the number of rows with each, those
    rows and how often each has the word.  ``word`` is in rising order."""
    used, rows = np.unique(word, return_counts=True)
    words = words.take(pa.array(used))
    bucket = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words)) % buckets
    order, of_row = np.argsort(bucket, kind="stable"), np.repeat(bucket, rows)
    each = np.argsort(of_row, kind="stable")
    found = np.unique(bucket)
    lists = lambda keys, values: pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(keys, found), len(keys)], pa.int32()), values)
    b, r = bucket[order], of_row[each]
    return [pa.array(found, pa.int32()), lists(b, words.take(pa.array(order))), lists(b, pa.array(rows[order], pa.int32())),
            lists(r, pa.array(ref[each], pa.int64())), lists(r, pa.array(times[each], pa.int64()))]


def _sums(ref: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct ``ref`` and the sums of ``values``."""
    ref, at = np.unique(ref, return_inverse=True)
    return [ref, *(np.bincount(at, v, len(ref)) for v in values)]


_ADDED = "ref long, refs array<long>, l array<double>, seen array<long>"


def _look_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """What the counts of a bucket's words add, a row for each row of ``texts``."""
    known, c = counts.column("word").combine_chunks(), counts.column("c").to_numpy()
    out = []
    for row in range(texts.num_rows):
        words, rows, refs, times = (texts.column(k)[row].values for k in ("words", "rows", "refs", "times"))
        code = _codes(words, known)
        count = np.where(code < 0, 0, c[code]) if len(c) else np.zeros(len(code))
        count, times = np.repeat(count, rows.to_numpy()), times.to_numpy()
        ref, l, seen = _sums(refs.to_numpy(), times * (np.log10(count + 0.5) - np.log10(0.5)), times * (count > 0))
        out.append((texts.column("ref")[row].as_py(), ref, l, seen.astype(np.int64)))
    lists = lambda k, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x[k]) for x in out])], pa.int32()), pa.array(
        np.concatenate([x[k] for x in out]) if out else [], kind))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), lists(1, pa.int64()), lists(2, pa.float64()), lists(3, pa.int64())], ["ref", "refs", "l", "seen"])


def _add_up(part: pa.Table) -> pa.Table:
    ref, l, seen = (pc.list_flatten(part.column(k)).to_numpy() for k in ("refs", "l", "seen"))
    ref, l, seen = _sums(ref, l, seen)
    return pa.table([pa.array(ref), pa.array(l), pa.array(seen.astype(np.int64))], ["ref", "l", "seen"])


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    held = F.coalesce(id_fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    training = rows.filter("NOT held_out")
    counts = materialize(count_words(training), "lm-counts")
    known = _vocabulary(counts)
    flat = fit(training, known)
    vocabulary = Vocabulary(*known)
    denominator, train_tokens = vocabulary.denominator, known[2]
    shapes = [a.shape for a in _network(vocabulary)]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known[3] // _ROWS))
    names = [f.split()[0] for f in _SCORED.split(", ")]
    sent = spark.sparkContext.broadcast((known, flat))  # KNOWN words and one network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*sent.value[0])
        p = _unpack(sent.value[1], [np.empty(s, np.float32) for s in shapes])
        for batch in batches:
            for part in _parts(batch, 3):
                flat, size = split_words(part.column(3))
                flat = flat.dictionary_encode()
                each = pa.concat_arrays([flat.dictionary.cast(pa.binary()), pa.array([END.encode()])])
                # What is known of every word, then of every token.
                code, symbol = v.encode(each), HEAD + tail_classes(each)
                hit = code >= 0
                inside, base = np.zeros(len(each)), np.zeros(len(each))
                inside[~hit] = -np.log(v.z[symbol[~hit] - HEAD])
                inside[hit], base[hit], symbol[hit] = v.inside[code[hit]], v.base[code[hit]], v.symbol[code[hit]]
                token, stop = with_ends(flat.indices.to_numpy(), size, len(each) - 1)
                start = stop - size - 1
                miss = np.flatnonzero(~hit[token])
                docs = np.split(symbol.astype(np.int16)[token], stop[:-1])
                with np.errstate(over="ignore"):
                    logp = score_batch(p, v, docs, docs) + np.add.reduceat(inside[token], start)
                pair, times = np.unique(np.searchsorted(stop, miss, side="right") + token[miss].astype(np.int64) * len(size), return_counts=True)
                known_tokens = np.add.reduceat(hit[token].astype(np.int64), start)
                rare_tokens = size + 1 - known_tokens
                texts = [pa.array(np.zeros(len(size), np.int32)), *part.columns[:3], pa.array(size + 1), pa.array(known_tokens),
                         pa.array(np.add.reduceat(base[token], start) + rare_tokens * np.log10(0.5)), pa.array(logp + rare_tokens * np.log(0.5))]
                ref = part.column(0).to_numpy()
                rare = _rare_words(each, pair // len(size), ref[pair % len(size)], times, buckets)
                group = [pa.array(np.ones(len(rare[0]), np.int32)), pa.array(np.full(len(rare[0]), ref[0]))]
                yield pa.RecordBatch.from_arrays(texts + [pa.nulls(len(size), x.type) for x in rare], names=names)
                yield pa.RecordBatch.from_arrays(group + [pa.nulls(len(rare[0]), x.type) for x in texts[2:]] + rare, names=names)

    # The number of a row tells rows of one id and text apart.
    numbered = rows.select(F.monotonically_increasing_id().alias("ref"), "doc_id", "held_out", "text")
    scored = materialize(numbered.mapInArrow(run, _SCORED), "lm-scored")
    # So far a rare word has count 0.  What its own count adds is looked up by
    # buckets of words, a bounded number of distinct ones each, and summed by row.
    bucket = (F.crc32("word") % F.lit(buckets)).cast("int").alias("bucket")
    rare = scored.filter("kind = 1").select("ref", "bucket", "words", "rows", "refs", "times").groupBy("bucket")
    rare = rare.cogroup(counts.select(bucket, "word", "c").groupBy("bucket")).applyInArrow(_look_up, _ADDED)
    rare = rare.groupBy("ref").applyInArrow(_add_up, "ref long, l double, seen long")
    both = scored.filter("kind = 0").select("ref", "doc_id", "held_out", "n_tokens", "n_known", "base", "logp").join(rare, "ref", "left")
    l, seen = F.coalesce("l", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    unknown = F.col("n_tokens") - F.col("n_known")
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + l - unknown * F.lit(float(np.log10(denominator)) if denominator > 0 else 0.0)).alias("base_score"),
        (F.col("logp") / F.lit(_LOG10) + l).alias("score"))
