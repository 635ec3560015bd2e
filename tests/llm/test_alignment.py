"""Alignment of two tokenizers against a byte-by-byte brute force."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from prospect.llm import alignment

pytestmark = pytest.mark.filterwarnings("ignore")
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "a\tb\n\n c ", "<s> x</s> <|endoftext|> y", "<0x41> and ▁ mark", "naïve café 你好 \U0001f600!",
       "\x00ctrl", "Straße 1234567 don't", "x" * 5000, "word " * 3000, "The same text twice.", "The same text twice."]


def brute(texts):
    """Result tuples from the libraries themselves and a byte-by-byte table."""
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = {i: t for t, i in tok.get_vocab().items()}
    chars = alignment.byte_of_char()
    docs, corpus = [], Counter()
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        raw_a = [bytes(chars[c] for c in names[i]) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            docs.append(None)
            continue
        at_a = [k for k, r in enumerate(raw_a) for _ in r]
        at_b = [k for k, r in enumerate(raw_b) for _ in r]
        linked = sorted(set(zip(at_a, at_b)))
        ends = sorted({k + 1 for k in range(len(at_a)) if k + 1 == len(at_a) or at_a[k] != at_a[k + 1]}
                      & {k + 1 for k in range(len(at_b)) if k + 1 == len(at_b) or at_b[k] != at_b[k + 1]})
        groups, lo = [], 0
        for hi in ends:
            left, right = sorted(set(at_a[lo:hi])), sorted(set(at_b[lo:hi]))
            groups.append(",".join(str(a[k]) for k in left) + "|" + ",".join(str(b[k]) for k in right))
            lo = hi
        pairs = [(a[i], b[j]) for i, j in linked]
        corpus.update(pairs)
        docs.append((len(a), len(b), groups, pairs))
    top = Counter()
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], len(d[2]), len(d[3]), sum(corpus[p] == top[p[1]] for p in d[3]), sum(corpus[p] for p in d[3]),
             hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


def result(df):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df]


@pytest.mark.parametrize("chunk_links", [1 << 24, 500])
def test_whole_documents_equal_brute_force(spark, chunk_links):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()] + ODD
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, chunk string, first int").repartition(3)
    got = alignment.align(docs, JSON, MODEL, chunk_links).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert result(got) == brute(texts)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "one text"), (None, "one text"), (7, "one text"), (7, None)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), JSON, MODEL).collect()
    assert sorted(result(got)) == sorted(brute([t for _, t in rows])) and sorted(str(r["doc_id"]) for r in got) == ["7", "7", "None", "None"]
    empty = alignment.align(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL)
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    assert alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), JSON, MODEL).first()["groups_sha256"] == ""


def test_the_file_is_run_like_the_library_reads_it():
    with open(JSON, encoding="utf-8") as f:
        spec = f.read()
    own, tok = alignment.ByteLevel(spec), Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    texts = [t for t in ODD if t] + ["  \n \t x", "I'll we've THEY'RE '' 's", "a" * 300 + " " * 300, "  x​̀", "١٢ ½ ①"]
    assert own.encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_an_unusual_file_goes_through_its_library():
    with open(JSON, encoding="utf-8") as f:
        spec = f.read().replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')
    assert alignment.ByteLevel(spec).encode(["the end"]) == [Tokenizer.from_str(spec).encode("the end").ids]


def test_packed_positions_come_back():
    import numpy as np

    for values in ([], [0], [1, 255, 256, 70_000, 1 << 31]):
        assert alignment.unpack(alignment.pack(np.array(values, np.int64))).tolist() == values
