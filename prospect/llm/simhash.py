"""SimHash near-duplicates by a binary-trie self-join (operator 7).

Fingerprints of word shingles (XXH64, seed 42, unsigned); a bit is set when
more than half of the shingle hashes have it.  Documents are first folded to
distinct fingerprints, so a group of exact copies, however large, is one node.

Two fingerprints at most ``k`` bits apart agree exactly on at least ``m - k``
of ``m`` bit blocks (pigeonhole).  Each choice of ``m - k`` blocks roots one
trie: its depth-first levels are those blocks, and rows meet at the node where
they agree.  Below that node the trie is joined with itself by walking *pairs
of nodes* together: every level splits both nodes on one bit, adds one to the
pair's differing bits when the children disagree, and drops the pair once the
budget is exceeded; pairs of leaves are finished with one popcount.  Nodes
holding more than ``NODE_ROWS`` fingerprints are dealt as pairs of salted
sub-nodes, so no task holds more than about that many rows of one node.  Every
task reduces the links it finds to a spanning forest, so links stay linear in
the fingerprints, and components are closed by the alternating star method on
tables written to the shared folder.

``m`` grows with the counted fingerprints (5 blocks up to half a million, then
6, 7, 8) the way a partition count does: the links found are the same.

Edge cases: NULL text is an empty text; texts without words have fingerprint
zero and link like any other; repeated rows share a fingerprint; a NULL
``doc_id`` takes part but never names a component unless all its members are
NULL (then ``component_id`` is NULL); an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.llm.common import fresh_names
from prospect.session import materialize, materialize_counted

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one trie node that are joined in one piece.
NODE_ROWS = 256
#: Rows joined at a time inside a task (whole nodes).
BATCH_ROWS = 8192
#: Average fingerprints per trie node that ``m`` is chosen for.
NODE_TARGET = 64
_HASHES_AT_A_TIME = 1 << 16
_NO_ID = (1 << 63) - 1


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined word shingles with repeats; fewer words: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [joined[a:b - 1] for a, b in zip(starts, ends[size - 1:])]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of ``text`` as an unsigned integer."""
    parts = shingles(text, size)
    if not parts:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(parts), _HASHES_AT_A_TIME):
        block = parts[at:at + _HASHES_AT_A_TIME]
        h = np.fromiter((digest(p, SEED) for p in block), dtype="<u8", count=len(block))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts), bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, size: int = SHINGLE) -> Column:
    """SimHash as a signed 64-bit column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.fromiter((fingerprint(t, size) for t in s), dtype=np.uint64, count=len(s)).view(np.int64))

    return run(text)


# ---------------------------------------------------------------- trie self-join

def _blocks(m: int) -> list[tuple[int, int]]:
    """``m`` (shift, width) blocks covering 64 bits."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    shifts = [0, *itertools.accumulate(widths)][:-1]
    return list(zip(shifts, widths))


def _tries(m: int, radius: int) -> list[list[tuple[int, int]]]:
    return [list(c) for c in itertools.combinations(_blocks(m), m - radius)]


def choose_blocks(fingerprints: int, radius: int) -> int:
    """Fewest blocks (at least ``radius + 1``) for which the exactly agreeing
    bits leave about ``NODE_TARGET`` fingerprints to a node."""
    m = radius + 1
    while m < radius + 4 and fingerprints >> min(w for w in (sum(x[1] for x in t) for t in _tries(m, radius))) > NODE_TARGET:
        m += 1
    return m


def _key(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    key = F.lit(0).cast("long")
    for shift, width in blocks:
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        key = F.shiftleft(key, width).bitwiseOR(part)
    return key


def join_nodes(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs within ``radius`` bits inside equal
    ``group`` values, by walking trie node pairs level by level."""
    order = np.lexsort((fp, group))
    g, f = group[order], fp[order]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    a0, a1 = lo[many], hi[many]
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int8)
    out_i, out_j = [], []

    def finish(i, j):
        near = np.bitwise_count(f[i] ^ f[j]) <= radius
        out_i.append(i[near])
        out_j.append(j[near])

    for bit in range(63, -1, -1):
        if not len(a0):
            break
        zeros = np.r_[0, np.cumsum(((f >> np.uint64(bit)) & np.uint64(1)) == 0)]
        am = a0 + zeros[a1] - zeros[a0]
        bm = b0 + zeros[b1] - zeros[b0]
        same = a0 == b0
        up = (err + 1).astype(np.int8)
        parts = [
            (a0, am, b0, bm, err, np.ones(len(a0), bool)),
            (am, a1, bm, b1, err, np.ones(len(a0), bool)),
            (a0, am, bm, b1, up, np.ones(len(a0), bool)),
            (am, a1, b0, bm, up, ~same),
        ]
        a0, a1, b0, b1, err, ok = (np.concatenate(x) for x in zip(*parts))
        na, nb = a1 - a0, b1 - b0
        ok &= (na > 0) & (nb > 0) & (err <= radius) & ~((a0 == b0) & (na == 1))
        leaf = ok & (na == 1) & (nb == 1)
        finish(a0[leaf], b0[leaf])
        ok &= ~leaf
        a0, a1, b0, b1, err = a0[ok], a1[ok], b0[ok], b1[ok], err[ok]
    # Nodes that reach the last level hold equal fingerprints (not met with
    # distinct input): link their rows to the first one.
    for x0, x1, y0, y1 in zip(a0, a1, b0, b1):
        j = np.r_[np.arange(x0, x1), np.arange(y0, y1)]
        out_i.append(np.full(len(j), x0))
        out_j.append(j)
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[np.concatenate(out_i)], order[np.concatenate(out_j)]


def spanning_links(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, representative) for rows of ``n`` linked to a smaller position."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(before, label):
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


_LINK_SCHEMA = "u struct<rep:long,fp:long>, v struct<rep:long,fp:long>"


def _node_join(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            t, key, sa, sb, rep, fp = cols
            edge = np.r_[False, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]
            i, j = join_nodes(np.cumsum(edge), fp.view(np.uint64), radius)
            x, y = spanning_links(len(fp), i, j)

            def node(p):
                return pa.StructArray.from_arrays([pa.array(rep[p]), pa.array(fp[p])], names=["rep", "fp"])

            return pa.RecordBatch.from_arrays([node(x), node(y)], names=["u", "v"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(at, BATCH_ROWS)
                cols = [piece.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
                cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
                t, key, sa, sb = cols[:4]
                new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1]))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield work([c[:cut] for c in cols])
                held = [c[cut:].copy() for c in cols]
        if held is not None and len(held[0]):
            yield work(held)

    return run


def near_links(nodes: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Spanning links between distinct fingerprints at most ``radius`` bits
    apart.  ``nodes``: (rep long, fp long), one row per fingerprint."""
    tries = _tries(choose_blocks(rows, radius), radius)
    dealt = nodes.select(
        "rep", "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("fp"), b).alias("key")) for t, b in enumerate(tries)])).alias("n"),
    ).select("rep", "fp", "n.t", "n.key")
    crowded = materialize(
        dealt.groupBy("t", "key").count().filter(F.col("count") > NODE_ROWS)
        .select("t", "key", F.ceil(F.col("count") * 2 / NODE_ROWS).cast("int").alias("parts")), "simhash-crowded")
    salted = (
        dealt.join(crowded, ["t", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.col("t").cast("int"), "key", F.least("own", "other").alias("sa"), F.greatest("own", "other").alias("sb"), "rep", "fp")
    )
    parts = salted.repartition("t", "key", "sa", "sb").sortWithinPartitions("t", "key", "sa", "sb")
    return parts.mapInArrow(_node_join(radius), _LINK_SCHEMA)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by
    alternating large-star and small-star steps until the links stop changing."""
    edges = materialize(links.filter("u != v").distinct(), name)
    known = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large, name)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = materialize(down.groupBy("u").agg(F.min("v").alias("m")), name)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u != v").distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = state


def _grouped(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """``near_duplicates`` with ``root_fp``, the fingerprint of the component's
    root node, which no other component has."""
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                    fingerprint_column(F.col("text"), size).alias("fp")), "simhash-rows")
    nodes, n = materialize_counted(
        rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).select(F.coalesce("rep", F.lit(_NO_ID)).alias("rep"), "fp"), "simhash-nodes")
    linked = components(near_links(nodes, n, radius), "simhash-links")
    named = nodes.join(linked.select(F.col("node.fp").alias("fp"), F.col("root.rep").alias("root"), F.col("root.fp").alias("root_fp")), "fp", "left")
    named = materialize(named.select("fp", F.coalesce("root_fp", "fp").alias("root_fp"), F.nullif(F.coalesce("root", "rep"), F.lit(_NO_ID)).alias("component_id")), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root_fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``;
    ``text_hash`` tells rows of one repeated ``doc_id`` apart."""
    return _grouped(docs, size, radius).drop("root_fp")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the
    smallest ``doc_id`` (NULL ids last; repeated rows: one of them)."""
    tagged = _grouped(docs, size, radius)
    # Rows are told apart by (id, text); the group's first such pair stays.
    winner = tagged.groupBy("root_fp").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("text_hash").alias("h"))).alias("w"))
    rows = tagged.groupBy("doc_id", "text_hash").count()
    rows = rows.select(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("text_hash").alias("h")).alias("w"), "count")
    own_id, own_hash, times = fresh_names(docs, "keep_id", "keep_hash", "keep_times")
    stay = materialize(winner.select("w").distinct().join(rows, "w").select(
        F.col("w.id").alias(own_id), F.col("w.h").alias(own_hash), F.col("count").alias(times)), "simhash-stay")
    cols = docs.columns
    kept = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), own_hash: F.xxhash64("text")}).join(stay, [own_id, own_hash])
    once = kept.filter(F.col(times) == 1)
    repeated = kept.filter(F.col(times) > 1).dropDuplicates([own_id, own_hash])
    return once.unionByName(repeated).select(*(F.col(f"`{c}`") for c in cols))
