"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospect.session import broadcast_row_limit

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+`` (fixed by the contracts).
SPACE_CLASS = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (NULL ids: NULL)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def words_of(text: Column) -> Column:
    """Whitespace-separated words of ``text`` as an array (NULL or empty: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint only when its counted rows fit the
    session's broadcast threshold; otherwise unhinted, so the join shuffles."""
    if rows <= broadcast_row_limit(df.sparkSession, row_bytes):
        return F.broadcast(df)
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.  A column used
    inside a lambda is otherwise computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that others cannot clash."""
    return df.select(*(F.col(n) for n in names))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it, for columns
    that are added to a caller's table and dropped again."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_of_char() -> dict[str, int]:
    """Byte behind each character of a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
