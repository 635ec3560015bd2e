"""The language model against plain arithmetic, and the deal of its streams."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospect.llm import lm


def _vocabulary():
    return lm.Vocabulary([b" "] + [b"w%d" % i for i in range(70)], [50] + list(range(71, 1, -1)), 3000, 71, {3: 9.0})


def _parameters(seed=1):
    rng = np.random.default_rng(seed)
    return [a.astype(np.float64) + rng.normal(0, 0.3, a.shape) for a in lm._network(_vocabulary())]


def _token_by_token(p, lane, end=0):
    """Negative log-probability of a lane, one symbol after the other."""
    emb, wx, u, b, wc, bc, ww, bw = p
    n, loss, h = lm.HIDDEN, 0.0, np.zeros(lm.HIDDEN)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    pick = lambda x, i: x[i] - np.log(np.exp(x).sum())
    for a, goal in zip(lane[:-1], lane[1:]):
        s = end if a == lm.CUT else a
        h = h * 0 if s == end else h
        x, r = emb[s] @ wx + b, h @ u
        z, g = sigmoid(x[:n] + r[:n]), sigmoid(x[n:2 * n] + r[n:2 * n])
        c = np.tanh(x[2 * n:] + g * r[2 * n:])
        h = c + z * (h - c)
        if a == lm.CUT or goal == lm.CUT:
            continue
        k = goal // lm.CLASS_WORDS if goal < lm.HEAD else lm.HEAD_CLASSES + goal - lm.HEAD
        loss -= pick(h @ wc + bc, k)
        if goal < lm.HEAD:
            loss -= pick(ww[k] @ h + bw[k], goal % lm.CLASS_WORDS)
    return loss


def test_gradient_is_that_of_the_token_by_token_loss():
    p, rng = _parameters(), np.random.default_rng(2)
    data = rng.integers(0, 40, (7, 3))
    data[2, 1], data[4, 0], data[5, 2] = lm.CUT, 0, lm.HEAD + 3
    grad, _, learned = lm._gradient([a.astype(np.float32) for a in p], data[:6], data[1:], np.zeros((3, lm.HIDDEN), np.float32), 0)
    assert learned == 16
    loss = lambda q: sum(_token_by_token(q, data[:, k]) for k in range(3))
    for i, a in enumerate(p):
        for at in rng.permutation(np.argwhere(np.abs(grad[i]) > 1e-3))[:3]:
            q = [x.copy() for x in p]
            q[i][tuple(at)] += 1e-5
            up = loss(q)
            q[i][tuple(at)] -= 2e-5
            assert grad[i][tuple(at)] == pytest.approx((up - loss(q)) / 2e-5, rel=1e-2, abs=1e-3)


def test_scores_are_those_of_the_token_by_token_loss():
    p, v, rng = _parameters(3), _vocabulary(), np.random.default_rng(4)
    docs = [np.r_[rng.integers(1, 71, n), 0] for n in (0, 5, 1, 700, 40, 40)]
    got = lm.score_batch([a.astype(np.float32) for a in p], v, docs, docs)
    assert got == pytest.approx([-_token_by_token(p, [0, *d]) for d in docs], rel=1e-4)


def test_streams_stay_short_under_equal_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "STREAM", 4000)
    monkeypatch.setattr(lm, "PIECE", 100)
    monkeypatch.setattr(lm, "DEALT", 4)
    rows = [(1, "the same words again " * 20)] * 300 + [(2, " ".join(f"w{i % 50}" for i in range(20_000)))] + [(9 + i, f"a b c{i}") for i in range(200)] + [(5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = lm._vocabulary(lm.count_words(df))
    dealt, streams = lm.training_streams(df, known)
    got = dealt.collect()
    # Every token is dealt once; the marks at cuts are no tokens.
    data = [(r["stream"], r["copies"], np.frombuffer(r["symbols"], "<i2")) for r in got]
    assert sum(n * int((s != lm.CUT).sum()) for _, n, s in data) == known[2]
    size = [sum(n * len(s) for k, n, s in data if k == i) for i in range(streams)]
    assert streams == -(-known[2] // 4000) and max(size) < 1.5 * 4000
    again = lm.training_streams(df.repartition(7, F.rand(3)), known)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_known_words_are_cut_by_count_and_length(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 5)
    monkeypatch.setattr(lm, "KNOWN_BYTES", 9)
    text = "a a a a a b b b b c c c d d e f g " + "long_words " * 9
    words, counts, total, distinct, _ = lm._vocabulary(lm.count_words(spark.createDataFrame([(text,)], "text string")))
    assert (words, counts, total, distinct) == ([b"a", b"b", b"c", b"d"], [5, 4, 3, 2], 27, 9)
    df = spark.createDataFrame([(i, text) for i in range(9)], "doc_id long, text string")
    rows = lm.score_documents(df).collect()
    assert all(r["n_known"] == r["n_tokens"] == 27 and r["score"] < 0 for r in rows)


def test_edges_null_ids_empty_tables_repeated_rows_clashing_columns(spark):
    text = "one two three . " * 5
    rows = [(None, text, 1, "x")] * 2 + [(None, None, 1, "x"), (0, "", 1, "x"), (3, None, 1, "x")] + [(4, text, 2, "y")] * 3 + [(i, f"{text} rare{i}", 3, "z") for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stream int, symbols string")
    got = lm.score_documents(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 6)))
    assert len(by[None]) == 3 and sorted(x[0] for x in by[None]) == [1, 21, 21]
    assert len(by[4]) == 3 and len(set(by[4])) == 1  # repeated rows count, and are scored alike
    assert by[0][0][0] == by[3][0][0] == 1
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert lm.score_documents(df.limit(0)).count() == 0
    held = df.filter("doc_id >= 10").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1")
    alone = lm.score_documents(held).collect()  # nothing to learn from
    assert alone
    for r in alone:
        assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"])


def test_words_and_shapes_are_those_of_the_plain_rule():
    texts = ["a  B\tc\x0b", None, "", " \n ", "\x00x  é Ünï \x1cd İ", " lead", "one,two. three! 4? (x) " * 3, "日本 " * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for part in (batch, batch.slice(3, 4)):
        flat, size = lm.split_words(part.column(0))
        plain = [lm.tokens(t) for t in part.column(0).to_pylist()]
        assert size.tolist() == [len(w) for w in plain]
        words = [w for ws in plain for w in ws]
        assert flat.cast(pa.binary()).to_pylist() == words

    def shape(w):
        last = w[-1:]
        end = 0 if last.isalnum() or last >= b"\x80" else 1 if last in b".,!" else 2
        return zlib.crc32(bytes((min(len(w).bit_length(), 4), w.isascii(), end, w[:1].isalpha()))) % lm.TAIL

    words += [b" ", b"a" * 7, b"a" * 8, b"a" * 300]
    got = lm.tail_classes(pa.array([b"skipped", *words], pa.binary()).slice(1))
    assert got.tolist() == [shape(w) for w in words]


def test_slices_of_a_batch_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(lm, "_BYTES", 10)
    for texts in ([], [None], ["", ""], ["x" * 35], ["abc"] * 20 + [None] + ["y" * 25] + [""] * 3):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        assert [t for p in lm._parts(batch, 0) for t in p.column(0).to_pylist()] == texts


def test_rare_words_are_summed_by_row():
    words = [b"p", b"q", b"r", b"s", b"t"]
    # (word, row, times) in order of words, for two groups of rows; t has no count.
    groups = {10: [(1, 10, 2), (1, 12, 1), (3, 10, 5), (4, 11, 3)], 20: [(0, 20, 1), (1, 20, 4)]}
    counts = {b"p": 3, b"q": 7, b"s": 1}
    rows = []
    for ref, triples in groups.items():
        w, r, n = (np.array(x) for x in zip(*triples))
        out = lm._rare_words(pa.array(words), w, r, n, 3)
        rows += [(ref, *x) for x in zip(*(a.to_pylist() for a in out))]
    by = {}
    for ref, bucket, ws, many, refs, times in rows:
        assert all(zlib.crc32(w) % 3 == bucket for w in ws) and sum(many) == len(refs) == len(times)
        by.setdefault(bucket, []).append((ref, ws, many, refs, times))
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    found = []
    for bucket, part in by.items():
        texts = pa.table([pa.array(x, k) for x, k in zip(zip(*part), kinds)], ["ref", "words", "rows", "refs", "times"])
        here = {w: c for w, c in counts.items() if zlib.crc32(w) % 3 == bucket}
        found.append(lm._look_up(texts, pa.table({"word": pa.array(list(here), pa.binary()), "c": pa.array(list(here.values()), pa.int64())})))
    got = {r["ref"]: (r["l"], r["seen"]) for r in lm._add_up(pa.concat_tables(found)).to_pylist()}
    want = {}
    for triples in groups.values():
        for w, r, n in triples:
            c = counts.get(words[w], 0)
            l, seen = want.get(r, (0.0, 0))
            want[r] = l + n * (np.log10(c + 0.5) - np.log10(0.5)), seen + n * (c > 0)
    assert got.keys() == want.keys()
    assert all(got[r] == pytest.approx(want[r]) for r in want)


def test_large_weights_stay_finite():
    p, v = _parameters(5), _vocabulary()
    p[4] *= 500  # logits of some hundreds, beyond the range of exp
    docs = [np.array([3, 9, 1, 30, 0])]
    got = lm.score_batch([a.astype(np.float32) for a in p], v, docs, docs)
    assert got == pytest.approx([-_token_by_token(p, [0, *docs[0]])], rel=1e-3)
    grad, _, _ = lm._gradient([a.astype(np.float32) for a in p], docs[0][:4, None], docs[0][1:, None], np.zeros((1, lm.HIDDEN), np.float32), 0)
    assert all(np.isfinite(g).all() for g in grad)
