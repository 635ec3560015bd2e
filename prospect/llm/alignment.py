"""Cross-tokenizer alignment (operator 11).

Each text is encoded by two tokenizers.  Where a token of both ends at one byte
both id lists are cut: the cumulative ends go into end-to-index dictionaries, the
intersection of their keys, sorted, slices both lists into groups.  Inside a group
every pair of tokens whose bytes overlap is a link; a slice with one token on a
side links it to all of the other side, any other slice is walked token by token.

Counting links over the corpus, without sending links through a shuffle:

1. A task aligns its documents in chunks of at most ``CHUNK_LINKS`` links (one
   longer document is a chunk of its own).  A chunk gives one row a document, with
   its distinct id pairs as packed positions in the chunk's sorted pair list, and
   that list with the chunk's counts.
2. Spark sums the counts of a pair over the chunks that hold it, and takes each B
   id's highest count (at most one row for each id of the vocabulary).
3. A chunk's documents meet the corpus counts of the chunk's own pairs, so no task
   holds more than a chunk.

Edge cases: NULL and empty texts, and texts that one tokenizer does not give back
byte for byte, have zeros and an empty hash; special tokens' strings inside texts
are plain text; repeated rows and NULL ids give a row each; very long texts are
encoded whole; ties for a B id's highest count all count as best; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospect.llm.common import byte_of_char, table_columns
from prospect.session import materialize

CHUNK_LINKS = 1 << 24
#: Bytes of text encoded and aligned in one go, and pairs in one row of a list.
_STEP_BYTES, _LIST = 1 << 18, 1 << 14
#: The split pattern that byte-level tokenizer files mean by ``use_regex`` (a fixed value).
_BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Ids of texts by a byte-level BPE file, special tokens as plain text.

    A file with the usual splitting, whose vocabulary lists bytes and then merges
    in order of rank, is run by the faster of the two libraries that read it."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(tokenizer_json)
        known = byte_of_char()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        spelled = {t: bytes(map(known.__getitem__, t)) for t in vocab}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
        for token, i in vocab.items():
            self.bytes[i] = spelled[token]
        for t in spec.get("added_tokens", []):
            self.bytes[t["id"]] = t["content"].encode()
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        ranked = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                  and pre.get("use_regex", True) and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
                  and len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)))
        #: Every byte is a token of its own at least, so nothing can be lost.
        self.lossless = ranked
        if ranked:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=_BYTE_LEVEL_PATTERN, mergeable_ranks={spelled[t]: i for t, i in vocab.items()}, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(tokenizer_json)
            tok.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids of texts by a sentencepiece model; it adds the leading space itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._spelled(i) for i in range(self.model.get_piece_size())]

    def _spelled(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte where tokens of both sides end, in order, the position
    after that token in either list."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = list(filter(at_b.__contains__, at_a))  # hash lookups; keys stand in order of insertion, so sorted
    return (np.fromiter(map(at_a.__getitem__, common), np.int64, len(common)),
            np.fromiter(map(at_b.__getitem__, common), np.int64, len(common)))


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of every pair of overlapping tokens, in order."""
    from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    n_a, n_b = cut_a - from_a, cut_b - from_b
    # A slice of n and m tokens, whose only common end is its last, has n + m - 1 links.
    size = n_a + n_b - 1
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    a = np.repeat(from_a, size) + np.where(np.repeat(n_a > 1, size), inside, 0)
    b = np.repeat(from_b, size) + np.where(np.repeat(n_b > 1, size), inside, 0)
    out = np.cumsum(size) - size
    for g in np.flatnonzero((n_a > 1) & (n_b > 1)).tolist():
        i, j, stop, to = int(from_a[g]), int(from_b[g]), int(out[g] + size[g]), int(out[g])
        while to < stop:
            a[to], b[to] = i, j
            to += 1
            if ends_a[i] < ends_b[j]:
                i += 1
            else:
                j += 1
    return a, b


def spelled_codes(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
    """The tokens of all groups in the order they are spelled in, as
    ``3 * id + mark``; the mark says what stands before it: ``;`` (0, a group's
    first A token), ``,`` (1) or ``|`` (2, a group's first B token)."""
    from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    n_a, n_b = cut_a - from_a, cut_b - from_b
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.repeat(from_b, n_a)] = 3 * ids_a + 1
    codes[np.arange(len(ids_b)) + np.repeat(cut_a, n_b)] = 3 * ids_b + 1
    codes[from_a + from_b] -= 1
    codes[cut_a + from_b] += 1
    return codes


def pack(values: np.ndarray) -> bytes:
    """Small unsigned integers, byte plane by byte plane, compressed."""
    return zstd.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


@dataclass
class _Part:
    """Distinct pairs of some documents: the sorted pairs with counts, and each
    document's positions in them with its own counts, documents one after another."""

    pairs: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    n: np.ndarray


class Aligner:
    """Aligns documents and keeps a chunk's pairs."""

    def __init__(self, side_a: ByteLevel, side_b: Pieces):
        self.a, self.b = side_a, side_b
        self.length_a, self.length_b = (np.fromiter(map(len, s.bytes), np.int64) for s in (side_a, side_b))
        self.spelled = [f"{mark}{i}" for i in range(max(len(side_a.bytes), len(side_b.bytes))) for mark in ";,|"]
        self.restart()

    def restart(self) -> None:
        self.rows: list[tuple] = []
        self.parts: list[_Part] = []
        self.links = 0

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        """Align documents and append their rows to the chunk."""
        whole = [k for k, t in enumerate(texts) if t]
        tokens: dict[int, tuple[list[int], list[int]]] = {}
        spaced = [" " + texts[k] for k in whole]
        for k, text, a, b in zip(whole, spaced, self.a.encode(spaced), self.b.encode([texts[k] for k in whole])):
            raw = text.encode("utf-8")
            if b"".join(map(self.b.bytes.__getitem__, b)) == raw and (self.a.lossless or b"".join(map(self.a.bytes.__getitem__, a)) == raw):
                tokens[k] = (a, b)
        # The documents of a step are one long text: every document's end is a common end.
        all_a = np.fromiter(chain.from_iterable(a for a, _ in tokens.values()), np.int64)
        all_b = np.fromiter(chain.from_iterable(b for _, b in tokens.values()), np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[all_a]), np.cumsum(self.length_b[all_b])
        list_a, list_b = ends_a.tolist(), ends_b.tolist()
        cut_a, cut_b = cuts(list_a, list_b)
        words = list(map(self.spelled.__getitem__, spelled_codes(all_a, all_b, cut_a, cut_b).tolist())) if len(cut_a) else []
        lasts = (np.searchsorted(cut_a, np.cumsum([len(a) for a, _ in tokens.values()])) + 1).tolist()
        sizes: list[int] = []
        done = group = 0
        for k, doc_id in enumerate(ids):
            if k not in tokens:
                self.rows.append((doc_id, 0, 0, 0, 0, ""))
                sizes.append(0)
                continue
            a, b = tokens[k]
            last, end = lasts.pop(0), done + len(a) + len(b)
            spelled = "".join(words[done:end])[1:]
            n_links = len(a) + len(b) - (last - group)
            self.rows.append((doc_id, len(a), len(b), last - group, n_links, hashlib.sha256(spelled.encode()).hexdigest()))
            sizes.append(n_links)
            done, group = end, last
        at_a, at_b = links(list_a, list_b, cut_a, cut_b) if len(cut_a) else (np.empty(0, np.int64),) * 2
        self.links += len(at_a)
        pairs, at, counts = np.unique(all_a[at_a] << 32 | all_b[at_b], return_inverse=True, return_counts=True)
        of_doc, n = np.unique(np.repeat(np.arange(len(ids)), sizes) << 32 | at, return_counts=True)
        self.parts.append(_Part(pairs, counts, np.bincount(of_doc >> 32, minlength=len(ids)), of_doc & 0xFFFFFFFF, n))

    def chunk(self) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Document rows with packed pairs, and the chunk's sorted pairs with
        counts; begins the next chunk."""
        pairs, where = np.unique(np.concatenate([p.pairs for p in self.parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([p.counts for p in self.parts]), len(pairs)).astype(np.int64)
        packed: list[bytes] = []
        done = 0
        for p in self.parts:
            at, ends = where[done + p.at], np.cumsum(p.sizes)
            done += len(p.pairs)
            for lo, hi in zip((ends - p.sizes).tolist(), ends.tolist()):
                # Positions rise inside a document, so their steps are small.
                packed.append(pack(np.concatenate([np.diff(at[lo:hi], prepend=0), p.n[lo:hi] - 1])))
        rows = [(*r, p) for r, p in zip(self.rows, packed)]
        self.restart()
        return rows, pairs, counts


_CHUNK = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, first long, list array<long>, counts array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                           ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("first", pa.int64()),
                           ("list", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def aligned_chunks(docs: DataFrame, json_path: str, model_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Rows of chunks: documents (``first`` is NULL) and slices of the chunk's
    pair list, from position ``first`` on."""
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # vocabulary files of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(shared.value[0]), Pieces(shared.value[1]))
        number = TaskContext.get().partitionId() << 32

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, pairs, counts = aligner.chunk()
            for lo in range(0, len(rows), 1024):
                doc_id, n_a, n_b, n_groups, n_links, sha, packed = zip(*rows[lo:lo + 1024])
                none = pa.nulls(len(doc_id))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(doc_id), pa.int64()), pa.array(doc_id, pa.int64()), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)),
                     pa.array(sha, pa.string()), pa.array(packed, pa.binary()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int64()))],
                    schema=_CHUNK_SCHEMA)
            for lo in range(0, len(pairs), _LIST):
                yield pa.RecordBatch.from_pylist([{"chunk": number, "first": lo, "list": pairs[lo:lo + _LIST], "counts": counts[lo:lo + _LIST]}], schema=_CHUNK_SCHEMA)
            number += 1

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _STEP_BYTES, "right")))
                aligner.add(ids[lo:hi], texts.slice(lo, hi - lo).to_pylist())
                lo = hi
                if aligner.links >= chunk_links:
                    yield from close()
        if aligner.rows:
            yield from close()

    return table_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CHUNK)


def align(docs: DataFrame, json_path: str, model_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of
    every row of ``docs``."""
    chunks = materialize(aligned_chunks(docs, json_path, model_path, chunk_links), "aligned-chunks")
    slices = chunks.filter("first IS NOT NULL").select("chunk", "first", F.posexplode(F.arrays_zip("list", "counts")))
    pairs = slices.select("chunk", (F.col("first") + F.col("pos")).alias("at"), F.col("col.list").alias("pair"), F.col("col.counts").alias("n"))
    # One row a pair and chunk, so even a pair of every text is as many rows as there are chunks.
    total = F.sum("n").over(Window.partitionBy("pair"))
    counted = materialize(pairs.select("chunk", "at", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), total.alias("total")), "aligned-pairs")
    highest = counted.groupBy("b").agg(F.max("total").alias("highest"))  # at most the B vocabulary
    known = counted.join(F.broadcast(highest), "b").select("chunk", "at", "total", (F.col("total") == F.col("highest")).alias("best"))

    out = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in
                     ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])

    def finish(mine: pa.Table, of_pairs: pa.Table) -> pa.Table:
        at = of_pairs["at"].to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = of_pairs["total"].to_numpy(), of_pairs["best"].to_numpy()
        n_best, count_sum = [], []
        for packed in mine["pairs"].to_pylist():
            values = unpack(packed).astype(np.int64)
            half = len(values) // 2
            where, n = np.cumsum(values[:half]), values[half:] + 1
            n_best.append(int(best[where] @ n))
            count_sum.append(int(total[where] @ n))
        return pa.table([mine["doc_id"], mine["n_a"], mine["n_b"], mine["n_groups"], mine["n_links"], pa.array(n_best, pa.int64()),
                         pa.array(count_sum, pa.int64()), mine["groups_sha256"]], schema=out)

    mine = chunks.filter("first IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
    return mine.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(finish, _OUT)
