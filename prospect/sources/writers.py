"""Sinks (S7, S8): Parquet with ZSTD and bounded row groups, CSV with header.

Writers run on the executors; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed value: rows per Parquet row group in the prepared tables.
ROW_GROUP_ROWS = 100_000


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", row_group_rows: int = ROW_GROUP_ROWS,
                  sort_within: list[str] | None = None, bloom: str | None = None) -> None:
    """ZSTD Parquet; ``sort_within`` clusters each file on the given
    columns so min / max statistics prune row groups for range filters
    (postcodes sorted by latitude make the radius box cheap).  ``bloom`` names a
    column that equality filters name but the rows are not sorted by: each row
    group gets a Bloom filter of its values."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = out.write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", str(row_group_rows))
    if bloom:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{bloom}", str(row_group_rows)))
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV folder with a header row (NULL -> empty field)."""
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
