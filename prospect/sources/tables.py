"""The five prepared tables, bundled, plus readers for a prepared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prospect.sources import schemas


@dataclass(frozen=True)
class Tables:
    """Prepared tables a search runs on (``companies``, ``company_sic``,
    ``postcodes``, ``psc``, ``officers``)."""

    companies: DataFrame
    company_sic: DataFrame
    postcodes: DataFrame
    psc: DataFrame
    officers: DataFrame
    profiles: DataFrame | None = None   # per-company profiles, when prepared
    search: DataFrame | None = None     # companies with their profiles in one row, laid out by location


def empty_officers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.OFFICERS)


def read_prepared(spark: SparkSession, folder: str) -> Tables:
    """Scan a prepared folder.  ``officers`` is optional: without it
    the search still runs and every officer aggregate is empty.  The
    per-company profiles and the pre-joined search table are used when the folder
    has them."""
    from prospect.sources.readers import path_exists, scan_officers

    folder = folder.rstrip("/")
    return Tables(
        companies=spark.read.parquet(f"{folder}/companies.parquet"),
        company_sic=spark.read.parquet(f"{folder}/company_sic.parquet"),
        postcodes=spark.read.parquet(f"{folder}/postcodes.parquet"),
        psc=spark.read.parquet(f"{folder}/psc.parquet"),
        officers=scan_officers(spark, f"{folder}/officers.parquet"),
        profiles=(spark.read.parquet(f"{folder}/company_profiles.parquet")
                  if path_exists(spark, f"{folder}/company_profiles.parquet") else None),
        search=(spark.read.parquet(f"{folder}/company_search.parquet")
                if path_exists(spark, f"{folder}/company_search.parquet") else None),
    )
