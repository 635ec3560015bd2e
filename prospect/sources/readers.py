"""Raw and prepared sources (S1-S6), always with explicit schemas."""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospect.sources import schemas


def _trim_header(df: DataFrame) -> DataFrame:
    """Header names with stray blanks (``' CompanyNumber'``) are trimmed."""
    renamed = [F.col(f"`{c}`").alias(c.strip()) for c in df.columns]
    return df.select(*renamed) if any(c != c.strip() for c in df.columns) else df


def _csv_header(spark: SparkSession, path) -> list[str]:
    """The header row of a CSV source (one line of one file comes back)."""
    import csv

    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return next(csv.reader([first[0][0]]))


def scan_csv_by_header(spark: SparkSession, path, known: dict, date_format: str | None = None,
                       strict: bool = False) -> DataFrame:
    """Typed CSV read where columns are matched by (trimmed) header name, so
    the file may carry extra fields in any order.  The schema is explicit
    (no inference pass): known fields get their type, others stay strings."""
    from pyspark.sql import types as T

    names = _csv_header(spark, path) or list(known)
    schema = T.StructType([T.StructField(n, known.get(n.strip(), T.StringType()), True) for n in names])
    # A file whose header differs from the schema's fails instead of shifting columns.
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).schema(schema)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    if strict:
        reader = reader.option("mode", "FAILFAST")
    return _trim_header(reader.csv(path))


def scan_companies_csv(spark: SparkSession, path) -> DataFrame:
    """Company register CSV, header row, strict (a malformed row aborts),
    dates as dd/MM/yyyy, header names trimmed."""
    return scan_csv_by_header(spark, path, dict(schemas.COMPANY_CSV_FIELDS), "dd/MM/yyyy", strict=True)


def scan_psc_ndjson(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """Owner snapshot, one JSON object per line.  Malformed lines are
    tolerated (PERMISSIVE); with ``keep_corrupt`` their text is kept in
    ``_corrupt_record`` for the drop accounting."""
    schema = schemas.PSC_JSON_WITH_CORRUPT if keep_corrupt else schemas.PSC_JSON
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("dateFormat", "yyyy-MM-dd")
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", schemas.CORRUPT_COLUMN)
    return reader.json(path)


def scan_postcodes_csv(spark: SparkSession, path) -> DataFrame:
    """S3: postcode directory CSV with header (the used fields typed)."""
    return scan_csv_by_header(spark, path, {f.name: f.dataType for f in schemas.POSTCODE_CSV.fields})


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A prepared Parquet table (projection and filters push down)."""
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its file system (one metadata call on the driver)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def scan_officers(spark: SparkSession, path: str) -> DataFrame:
    """Officer appointments; an absent input is an empty table."""
    from prospect.sources.tables import empty_officers

    if not path_exists(spark, path):
        return empty_officers(spark)
    return spark.read.parquet(path).withColumns({
        "company_number": F.col("company_number").cast("string"),
        "appointment_date": F.col("appointment_date").cast("bigint")})


# Month abbreviations of the postcode directory's release names.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_RELEASE = re.compile(r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)_(\d{4})")
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})")


def snapshot_date(path: str) -> _dt.date | None:
    """Release date encoded in a snapshot's path (``ONSPD_FEB_2025``,
    ``...-snapshot-2025-01-01.txt``); None if it carries none.  Spark's own
    ``part-...`` file names are ignored."""
    parts = [p for p in path.split("/") if p and not p.startswith("part-")]
    for part in reversed(parts):
        m = _RELEASE.search(part)
        if m:
            return _dt.date(int(m.group(2)), MONTHS.index(m.group(1)) + 1, 1)
        m = _ISO.search(part)
        if m:
            return _dt.date(int(m.group(1)), int(m.group(2)), int(m.group(3)))
    return None


def newest_files(spark: SparkSession, pattern: str) -> tuple[_dt.date, list[str]]:
    """Release date and files of the newest snapshot matching ``pattern``,
    from the file listing alone."""
    files = spark.read.text(pattern).inputFiles()
    dated = [(snapshot_date(f), f) for f in files]
    dated = [(d, f) for d, f in dated if d is not None]
    if not dated:
        raise ValueError(f"no dated snapshot matches {pattern}")
    newest = max(d for d, _ in dated)
    return newest, sorted({f for d, f in dated if d == newest})


def latest_snapshot(spark: SparkSession, pattern: str, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Read only the newest snapshot among the files matching ``pattern``.

    Snapshots are ordered by the *date* in their names (a lexical maximum
    would put NOV_2024 after FEB_2025).  The choice is made from the file
    listing alone (no data is read), and only the chosen files are handed to
    ``read`` (e.g. ``lambda files: scan_postcodes_csv(spark, files)``), so
    older snapshots are never scanned.  A ``snapshot_date`` column records
    the choice.
    """
    newest, keep = newest_files(spark, pattern)
    return read(keep).withColumn("snapshot_date", F.lit(newest))
