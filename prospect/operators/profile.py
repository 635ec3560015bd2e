"""Profiling of raw sources before the prepare stage.

Scalar metrics are single ``agg`` passes and breakdowns single ``groupBy``
passes; top-k lists are ``orderBy().limit()`` (each task keeps its own top k,
so nothing large meets in one place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospect.operators.prepare import INDIVIDUAL_KIND
from prospect.operators.quality import _bounds


# SQL names of the column types a raw source can have.
SQL_TYPE_NAMES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
                  "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def schema_preview(df: DataFrame, n: int = 20) -> DataFrame:
    """position, name and SQL type of the first ``n`` columns (schema
    metadata only; no data is read)."""
    rows = [(i + 1, f.name, SQL_TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()))
            for i, f in enumerate(df.schema.fields[:n])]
    return df.sparkSession.createDataFrame(rows, "position bigint, column_name string, data_type string")


def row_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """row count of each named source (one count aggregate each)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source"), "row_count")
             for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _topk(df: DataFrame, col, name: str, k: int, count_name: str) -> DataFrame:
    return (
        df.groupBy(col.alias(name)).agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.col(count_name).desc(), F.col(name))
        .limit(k)
    )


def status_topk(raw_companies: DataFrame, k: int = 10) -> DataFrame:
    """the ``k`` most common company statuses."""
    return _topk(raw_companies, F.col("`CompanyStatus`"), "CompanyStatus", k, "companies")


def category_topk(raw_companies: DataFrame, k: int = 10) -> DataFrame:
    """the ``k`` most common account categories (unknown excluded)."""
    cat = F.col("`Accounts.AccountCategory`")
    return _topk(raw_companies.where(cat.isNotNull()), cat, "category", k, "companies")


def psc_sample(raw_psc: DataFrame) -> DataFrame:
    """one owner record (the first by company number and name)."""
    return raw_psc.orderBy("company_number", F.col("data.name")).limit(1)


def kind_breakdown(raw_psc: DataFrame) -> DataFrame:
    """owner records per kind, with a shortened label ('NULL' if none)."""
    counts = raw_psc.groupBy(F.col("data.kind").alias("kind")).agg(F.count(F.lit(1)).alias("records"))
    short = F.replace(F.replace(F.col("kind"), F.lit("individual-"), F.lit("")),
                      F.lit("-with-significant-control"), F.lit(""))
    return counts.select(F.coalesce(short, F.lit("NULL")).alias("kind_short"), "records")


def active_vs_ceased(raw_psc: DataFrame) -> DataFrame:
    """individual owners, active versus ceased."""
    status = F.when(F.col("data.ceased_on").isNull(), F.lit("Active")).otherwise(F.lit("Ceased"))
    return (raw_psc.where(F.col("data.kind") == INDIVIDUAL_KIND)
            .groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("records")))


def postcode_termination(raw_postcodes: DataFrame) -> DataFrame:
    """F8: postcodes, live versus terminated."""
    status = F.when(F.col("doterm").isNull(), F.lit("Active")).otherwise(F.lit("Terminated"))
    return raw_postcodes.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("postcodes"))


def live_geocoded(raw_postcodes: DataFrame) -> DataFrame:
    return raw_postcodes.where(F.col("doterm").isNull() & F.col("lat").isNotNull() & F.col("long").isNotNull())


def coordinate_bounds(raw_postcodes: DataFrame) -> DataFrame:
    """coordinate ranges of live postcodes and the UK-bounds check."""
    return _bounds(live_geocoded(raw_postcodes), None)


def postcode_samples(raw_postcodes: DataFrame, n: int = 5) -> DataFrame:
    """``n`` live postcodes with coordinates (first by ``pcds``)."""
    return (raw_postcodes.where(F.col("doterm").isNull() & F.col("lat").isNotNull())
            .select("pcds", "lat", "long").orderBy("pcds").limit(n))
