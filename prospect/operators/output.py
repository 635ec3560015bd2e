"""Output shaping (O1-O5): output columns, ordering, top-N, pages."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospect.functions.expressions import as_of_date, round_half_away, year_diff
from prospect.session import materialize, materialize_counted, output_partitions

# The result's 26 column names, in order (from the reference).
OUTPUT_COLUMNS = [
    "CompanyNumber", "CompanyName", "Postcode", "DistanceMiles", "CompanyStatus", "CompanyCategory",
    "AccountCategory", "IncorporationDate", "CompanyAgeYears", "LastAccountsDate", "SicCodeCount",
    "PrimarySicCode", "PrimarySicDescription", "PscCount", "YoungestPscAge", "OldestPscAge",
    "PscLastUpdated", "MinPscTenureYears", "MaxPscTenureYears", "AvgPscTenureYears", "OfficerCount",
    "EarliestOfficerAppointment", "LatestOfficerAppointment", "MinOfficerTenureYears",
    "MaxOfficerTenureYears", "AvgOfficerTenureYears",
]
ORDER_KEYS = ["distance_miles", "CompanyNumber"]


def output_columns(as_of: _dt.date | str | None, sources: dict | None = None):
    """The 26 output expressions; ``sources`` maps internal column names to
    expressions that compute them (used to derive enrichment in place)."""
    src = sources or {}

    def c(name: str):
        return src.get(name, F.col(name))

    return [
        F.col("CompanyNumber"),
        F.col("CompanyName"),
        F.col("RegAddressPostCode").alias("Postcode"),
        round_half_away("distance_miles", 2).alias("DistanceMiles"),
        F.col("CompanyStatus"),
        F.col("CompanyCategory"),
        F.col("AccountCategory"),
        F.col("IncorporationDate"),
        year_diff(as_of_date(as_of), "IncorporationDate").alias("CompanyAgeYears"),
        F.col("AccountsLastMadeUpDate").alias("LastAccountsDate"),
        c("sic_count").alias("SicCodeCount"),
        c("primary_sic_code").alias("PrimarySicCode"),
        c("primary_sic_description").alias("PrimarySicDescription"),
        c("psc_count").alias("PscCount"),
        c("youngest_psc_age").alias("YoungestPscAge"),
        c("oldest_psc_age").alias("OldestPscAge"),
        c("psc_last_updated").alias("PscLastUpdated"),
        c("min_psc_tenure_years").alias("MinPscTenureYears"),
        c("max_psc_tenure_years").alias("MaxPscTenureYears"),
        c("avg_psc_tenure_years").alias("AvgPscTenureYears"),
        c("officer_count").alias("OfficerCount"),
        c("earliest_officer_appointment").alias("EarliestOfficerAppointment"),
        c("latest_officer_appointment").alias("LatestOfficerAppointment"),
        c("min_officer_tenure_years").alias("MinOfficerTenureYears"),
        c("max_officer_tenure_years").alias("MaxOfficerTenureYears"),
        c("avg_officer_tenure_years").alias("AvgOfficerTenureYears"),
    ]


def order_by_distance(df: DataFrame) -> DataFrame:
    """O2: nearest first, on the unrounded distance; ties by company number."""
    return df.orderBy(*ORDER_KEYS)


#: Largest ``n`` for which the driver merges every task's own nearest ``n``.
TAKE_ROWS = 100_000
#: Histogram bins a mile: at most 99,600 up to half the earth's circumference.
BINS_PER_MILE = 8


def nearest_top_n(df: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` nearest, in order.  ``None`` / 0 = no limit.

    Up to ``TAKE_ROWS`` this plans as TakeOrderedAndProject: each task keeps its
    own top ``n``, the driver merges them.  Beyond, see ``select_nearest``."""
    if n and int(n) > TAKE_ROWS:
        return select_nearest(df, int(n))
    ordered = order_by_distance(df)
    return ordered.limit(int(n)) if n else ordered


def select_nearest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest without meeting in one task: a histogram of distances
    gives the bin in which the ``n``-th lies, rows beyond it are dropped at the
    scan, the others are numbered by a distributed sort and cut at ``n`` exactly
    (ties by company number)."""
    stage, rows = materialize_counted(df, "nearest-input")
    if rows <= n:
        return order_by_distance(stage)
    bin_ = F.floor(F.col("distance_miles") * BINS_PER_MILE)
    bins = stage.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    # A bounded number of bins, so their running sum may meet in one task.
    running = bins.select("bin", F.sum("rows").over(Window.orderBy("bin")).alias("until"))
    cut = running.where(F.col("until") >= n).agg(F.min("bin")).first()[0]
    numbered, _ = number_rows(stage.where(bin_ <= F.lit(cut)), ORDER_KEYS, stored=True)
    return order_by_distance(numbered.where(F.col("row_in_result") <= n).drop("row_in_result"))


def number_rows(df: DataFrame, order_keys: list[str], stored: bool = False) -> tuple[DataFrame, int]:
    """``df`` with ``row_in_result`` (from 1, in order), and the number of rows.

    The rows are range-partitioned and sorted on the keys; a row's position
    inside its partition comes from ``monotonically_increasing_id`` (partition id
    in the upper bits, row index in the lower 33), and a per-partition count gives
    each partition's offset.  Only those counts (one row per partition, a proven
    bound) meet in one place; the rows never do.  The input is written first
    unless it is ``stored``: a range partitioning reads it twice, and its size
    decides the partitions.  The sorted frame is written too, so that the ids
    are stable if anything downstream is re-executed."""
    stage = df if stored else materialize(df, "rows")
    ranked = stage.repartitionByRange(output_partitions(stage), *order_keys).sortWithinPartitions(*order_keys)
    ranked = ranked.withColumn("_mid", F.monotonically_increasing_id())
    ranked, rows = materialize_counted(
        ranked.withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid"), "numbered")
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = ranked.join(F.broadcast(offsets), "_pid").withColumn("row_in_result", (F.col("_off") + F.col("_local") + 1).cast("bigint"))
    return numbered.drop("_pid", "_local", "_off"), rows


def _page(page_size: int) -> Column:
    return F.floor((F.col("row_in_result") - 1) / F.lit(int(page_size))).cast("bigint")


def result_pages(df: DataFrame, page_size: int = 10_000, order_keys: list[str] | None = None) -> DataFrame:
    """Page number (from 0) and position of every row of the ordered result."""
    return number_rows(df, order_keys or ORDER_KEYS)[0].withColumn("page", _page(page_size))


def write_pages(df: DataFrame, path: str, page_size: int = 10_000, rows_per_file: int = 1_000_000,
                order_keys: list[str] | None = None) -> DataFrame:
    """O5 as a table to be read page by page: ``rows/file=K`` holds whole pages in
    order, about ``rows_per_file`` rows each, and ``manifest`` says for each page its
    file, first row and number of rows.  Returns the manifest."""
    numbered, rows = number_rows(df, order_keys or ORDER_KEYS)
    pages_per_file = max(1, rows_per_file // page_size)
    page = _page(page_size)
    placed = numbered.withColumn("page", page).withColumn("file", F.floor(F.col("page") / F.lit(pages_per_file)).cast("bigint"))
    files = max(1, -(-rows // (pages_per_file * page_size)))
    path = path.rstrip("/")
    (placed.repartitionByRange(files, "file").sortWithinPartitions("file", "row_in_result")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("file").parquet(f"{path}/rows"))
    manifest = placed.groupBy("page", "file").agg(F.min("row_in_result").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # one short row a page
    return df.sparkSession.read.parquet(f"{path}/manifest")


def read_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """The rows of one page, in order, read from its file alone; no rows for a
    page that the manifest does not have."""
    path = path.rstrip("/")
    found = spark.read.parquet(f"{path}/manifest").where(F.col("page") == int(page)).select("file").first()
    rows = spark.read.parquet(f"{path}/rows" if found is None else f"{path}/rows/file={found[0]}")
    wanted = rows.where(F.lit(False)) if found is None else rows.where(F.col("page") == int(page))
    return wanted.orderBy("row_in_result").drop("page", "file", "row_in_result")
