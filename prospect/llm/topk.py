"""Exact top-k inner products by a vector-approximation file (operator 6).

Vectors become integers (``floor(1024 x)``).  The approximation cuts every
dimension's range into 256 equal cells and stores one byte per component next
to the exact vector.  Candidates are dealt into chunks of about ``CHUNK`` rows
and queries into blocks of about ``BLOCK``; every (chunk, block) cell is one
bounded group.  Inside a cell the bytes alone give an upper bound of every
(query, candidate) score; exact vectors are then read in the order of their
bounds until the k-th exact score is above every bound that is left.  The best
``k`` of a query over all chunks are its answer; at most ``k`` rows per query
and chunk are shuffled for that.

Edge cases: vectors that are NULL, empty or hold a NULL, NaN or infinite
component take no part; queries meet candidates of their own dimension only; a repeated
query id is one query (its smallest vector) and no row of that id is its
candidate; equal scores go to the smaller id; fewer candidates than ``k`` give
fewer rows; an empty table gives none.  Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.session import materialize, materialize_counted

SCALE = 1024
CELLS = 256
CHUNK = 1024
BLOCK = 256
_READ = 32


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, v array<long>) of the usable rows."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return df.filter((F.size(embedding) > 0) & F.col(vec_id).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("dim"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


def cell_grid(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension count: lowest value and cell width of every component."""
    spans = vectors.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict[int, list] = {}
    for r in spans.orderBy("dim", "pos").collect():  # one row per component
        out.setdefault(r["dim"], []).append((r["lo"], -(-(r["hi"] - r["lo"] + 1) // CELLS)))
    return {d: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for d, rows in out.items()}


def approximate(vectors: DataFrame, grid: dict) -> DataFrame:
    """(vec_id, dim, cells binary, exact binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2)
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(vec.value_lengths().to_numpy())]
            cells, exact = [], []
            for i, d in enumerate(batch.column(1).to_pylist()):
                v = flat[at[i]:at[i + 1]].astype("<i8")
                lo, width = grid.get(d, (np.zeros(0, np.int64), np.ones(0, np.int64)))
                cells.append(((v - lo) // width).astype(np.uint8).tobytes())
                exact.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary()), pa.array(exact, pa.binary())],
                                             names=["vec_id", "dim", "cells", "exact"])

    return vectors.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, cells binary, exact binary")


def best_in_cell(query: np.ndarray, own: int, ids: np.ndarray, bound: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k`` rows, reading exact vectors in the
    order of ``bound`` until no unread row can enter."""
    order = np.lexsort((ids, -bound))
    order = order[ids[order] != own]
    best_id, best = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(order), _READ):
        if len(best) == k and bound[order[at]] < best[-1]:
            break
        rows = order[at:at + _READ]
        best_id = np.r_[best_id, ids[rows]]
        best = np.r_[best, exact[rows] @ query]
        top = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[top], best[top]
    return best_id, best


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact best ``k`` of every query.

    Both inputs: (vec_id, dim, v) from ``integer_vectors``; every query row is
    compared with every vector row of another id."""
    vectors, n = materialize_counted(vectors, "topk-vectors")
    queries, nq = materialize_counted(queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select(
        "vec_id", "q.dim", "q.v"), "topk-queries")
    grid = cell_grid(vectors)
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-nq // BLOCK))

    def deal(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    file = materialize(approximate(vectors, grid), "topk-file")
    left = file.withColumn("chunk", deal(F.col("vec_id"), chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", deal(F.col("vec_id"), blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(q):
            d = int(c["dim"].iloc[0])
            lo, width = grid[d]
            code = np.frombuffer(b"".join(c["cells"]), np.uint8).reshape(-1, d).astype(np.int64)
            exact = np.frombuffer(b"".join(c["exact"]), "<i8").reshape(-1, d)
            low = lo + code * width
            high = low + width - 1
            ids = c["vec_id"].to_numpy(np.int64)
            qs = np.array(q["v"].tolist(), dtype=np.int64).reshape(-1, d)
            # Bounds in floats, widened by more than their rounding error.
            bound = np.maximum(qs, 0).astype(float) @ high.T.astype(float) + np.minimum(qs, 0).astype(float) @ low.T.astype(float)
            bound += 1e-9 * (np.abs(qs).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T.astype(float))
            for i, own in enumerate(q["vec_id"].to_numpy(np.int64)):
                found, score = best_in_cell(qs[i], own, ids, bound[i], exact, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dim", "chunk", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
