"""Token-id files with 64-bit offsets, memory-mapped (operator 8).

Documents are range-partitioned and sorted by ``doc_id`` and, inside one id, by a
hash of the text, so that rows of one hot or missing id spread; each task encodes its
range and writes three flat little-endian files next to each other:

* ``<part>.ids``: unsigned token ids (16 bits if the vocabulary fits, else 32),
  every document followed by the end id;
* ``<part>.docs``: signed 64-bit document ids;
* ``<part>.offsets``: unsigned 64-bit document offsets into the *whole* token
  sequence, one more than documents.

A part's base is the prefix sum of the token counts of the parts before it,
taken over one manifest row per part; offsets are written once the bases are
known.  File names carry the task attempt, and the manifest names the files of
the attempt that finished, so a retried or speculative task cannot mix files.

Encoding is the tokenizers library's, as its file says.  Byte-level tokenizers
split text at single spaces and newlines between visible characters, so words are
encoded once, by the library's own splitter and model, and remembered (a bounded
table); texts that hold an added token, and other texts and tokenizers, are
encoded whole.

Edge cases: NULL and empty texts hold the end id alone; NULL ids come first;
repeated rows are written each, beside each other; an empty table gives an empty
manifest and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401 - used as pa.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospect.llm.common import byte_of_char
from prospect.session import materialize, scratch_path

#: Remembered words per task; the table starts anew beyond it.
PIECES = 400_000
_ROWS_OUT = 4096


def _local(path: str) -> str | None:
    """Plain path of a ``file:`` URI or bare path; None for another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def write_bytes(path: str, chunks: Iterator[bytes]) -> None:
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.writelines(chunks)
        return
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at) as f:
        for c in chunks:
            f.write(c)


def map_array(path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped on a mounted folder, one buffer
    from a remote store."""
    local = _local(path)
    if local is not None:
        return np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def splits_at_spaces(tokenizer_json: str) -> bool:
    """Whether the tokenizer cuts before single spaces: byte level, its own
    pattern, nothing rewritten before."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True))


def _visible(ch: str) -> bool:
    """A single character that no tokenizer takes for white space."""
    return "!" <= ch <= "~" or ch.isalnum()


class _Words(dict):
    """Ids of words, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class _Whole(Exception):
    """The text cannot be cut into words."""


#: Characters that end a word as a piece of their own.
_STOPS = ".,;:!?"
#: Letters below this are letters in every version of the character tables.
_LATIN = "\u0250"


class Encoder:
    """Token ids of texts, remembering the ids of words.

    A byte-level tokenizer starts a new piece at a single space before a
    visible character, and treats a single newline between visible characters
    as a piece of its own; so a text whose words and lines all start and end
    that way is the ids of its words, each known by its place (after a space or
    at the start of a line).  Any other text is encoded whole."""

    def __init__(self, tokenizer_json: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.dtype = dtype
        self.code = "H" if dtype == "<u2" else "I"  # of little-endian machines, as the files are
        self.tokenize = self.tok.model.tokenize
        self.by_word = splits_at_spaces(tokenizer_json)
        self.added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
        self.spaced, self.first = _Words(self._after_space), _Words(self._at_start)
        if self.by_word:
            split = self.tok.pre_tokenizer.pre_tokenize_str
            self.newline = self._raw(["\n"])[0]
            self.stops = {c: self._pieces(split("x" + c)[1:]) for c in _STOPS}
            self.shown = {b: c for c, b in byte_of_char().items()}
            self.space = split(" x")[0][0][0]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces) -> bytes:
        return array(self.code, [t.id for p, _ in pieces for t in self.tokenize(p)]).tobytes()

    def _after_space(self, word: str) -> bytes:
        if not word or not _visible(word[0]):
            raise _Whole
        if word[-1] in _STOPS and len(word) > 1 and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.stops[word[-1]]
        if word.isalpha() and (word.isascii() or max(word) < _LATIN):
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
            return array(self.code, [t.id for t in self.tokenize(self.space + spelled)]).tobytes()
        return self._pieces(self.tok.pre_tokenizer.pre_tokenize_str(" " + word))

    def _at_start(self, word: str) -> bytes:
        if not word or not _visible(word[0]):
            raise _Whole
        return self._pieces(self.tok.pre_tokenizer.pre_tokenize_str(word))

    def encode_one(self, text: str) -> bytes:
        if any(a in text for a in self.added) or len(text) > PIECES:
            return self._raw([text])[0]
        out = []
        try:
            for line in text.split("\n"):
                if not _visible(line[-1:]):
                    return self._raw([text])[0]
                head, *rest = line.split(" ")
                out.append(self.first[head] + b"".join(map(self.spaced.__getitem__, rest)))
        except _Whole:
            return self._raw([text])[0]
        return self.newline.join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        if not self.by_word:
            return self._raw(texts)
        out = []
        for t in texts:
            if len(self.spaced) + len(self.first) > PIECES:
                self.spaced.clear()
                self.first.clear()
            out.append(self.encode_one(t) if t else b"")
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``folder``; returns the manifest:
    one row per part with its file, counts and base."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # a vocabulary file of fixed size
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(spec)
    schema = "part int, file string, dtype string, docs long, nulls long, tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        enc = Encoder(shared.value, dtype)
        end = np.asarray([end_id], dtype=dtype).tobytes()
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        nulls = 0

        def encoded() -> Iterator[bytes]:
            nonlocal nulls
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    key = piece.column(0)
                    nulls += key.null_count
                    ids.append(key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                    rows = enc.encode([t or "" for t in piece.column(1).to_pylist()])
                    sizes.append(np.fromiter((len(r) // np.dtype(dtype).itemsize + 1 for r in rows), "<u8", len(rows)))
                    yield end.join(rows) + end

        first = next(iter(batches), None)
        if first is None:
            return
        rest = batches
        batches = (b for part in ([first], rest) for b in part)
        write_bytes(name + ".ids", encoded())
        count = np.concatenate(sizes)
        write_bytes(name + ".docs", iter([np.concatenate(ids).tobytes()]))
        write_bytes(name + ".sizes", iter([count.tobytes()]))
        yield pa.RecordBatch.from_pylist([{"part": ctx.partitionId(), "file": name, "dtype": dtype, "docs": len(count),
                                           "nulls": nulls, "tokens": int(count.sum())}],
                                         schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("dtype", pa.string()),
                                                           ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    ranged = keyed.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    parts = materialize(ranged.mapInArrow(run, schema), "token-parts")
    # One row per part: the bases are a running sum in part order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = materialize(parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-manifest")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = map_array(r["file"] + ".sizes", "<u8")
                at = np.concatenate([np.zeros(1, "<u8"), np.cumsum(size, dtype="<u8")]) + np.uint64(r["base"])
                write_bytes(r["file"] + ".offsets", iter([at.astype("<u8").tobytes()]))
            yield batch

    spread = manifest.repartition(max(1, manifest.count()), "part")
    return materialize(spread.mapInArrow(offsets, manifest.schema), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.
    The CRC is over the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = map_array(r["file"] + ".ids", r["dtype"])
                at = map_array(r["file"] + ".offsets", "<u8").astype(np.int64)
                key = map_array(r["file"] + ".docs", "<i8")
                local = at - r["base"]
                for lo in range(0, len(key), _ROWS_OUT):
                    hi = min(lo + _ROWS_OUT, len(key))
                    crc = [zlib.crc32(ids[local[i]:local[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    none = np.arange(lo, hi) < r["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(key[lo:hi]), mask=none), pa.array(at[lo:hi]), pa.array(np.diff(at[lo:hi + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files (default: a fresh folder beside the scratch tables) and
    read every document back."""
    return read_token_files(write_token_files(docs, folder or scratch_path(spark, "token-files"), tokenizer_path, end_id))
