"""Prepare pipeline (the reference's setup entry): raw snapshots -> prepared
Parquet folder, plus the data-quality report.

A sixth table, ``company_profiles``, holds one row per company with the
request-independent aggregates (``operators.aggregates.company_profiles``),
so a search joins it instead of aggregating owners, officers and industry
codes at query time.

A seventh, ``company_search``, holds each company's row and its profile in one,
so that a search, single or batch, tests every condition on one scan and joins
no profile.

Layout for searching at scale: the tables a search scans — companies, profiles
and the search table — carry each company's coordinates (``geo_lat``, ``geo_long``, from
its registered postcode; NULL when it has none) and are written
range-partitioned and sorted by them.  A search's literal bounding box then
reaches both scans as pushed filters, and Parquet skips the row groups
outside the area; the postcode table is laid out the same way on its own
``lat`` / ``long``.  The prepared tables keep all the reference's columns;
the location columns are extra.  (Detail tables given the location columns
by other means are pruned the same way when profiles are built on the fly.)

The raw company register is parsed once and materialized (it feeds the
companies table, the industry-code table and the parse report); every write
is ZSTD Parquet with bounded row groups.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prospect.operators import prepare as P
from prospect.operators.geo import STORED_KEY, geocode_companies, key_of, with_stored_key
from prospect.operators.aggregates import company_profiles
from prospect.operators import profile as PF
from prospect.operators import quality as Q
from prospect.plans.search import CANDIDATE_COLUMNS
from prospect.session import broadcast_row_limit, materialize, output_partitions
from prospect.sources.tables import Tables, empty_officers, read_prepared
from prospect.sources.writers import write_parquet

GEO_COLUMNS = ["geo_lat", "geo_long"]
POSTCODE_ROW_BYTES = 64


@dataclass(frozen=True)
class RawSources:
    companies: DataFrame      # register rows, CSV header names
    psc: DataFrame            # nested owner records
    postcodes: DataFrame      # directory rows
    officers: DataFrame | None = None
    psc_files: tuple[str, ...] = ()     # the owner records' files, for the drop report
    register_parsed: bool = False       # companies is a stage table already


# The raw snapshot file names of the original data sources.
COMPANIES_PATTERN = "BasicCompanyDataAsOneFile-*.csv"
PSC_PATTERN = "persons-with-significant-control-snapshot-*.txt"
POSTCODES_PATTERN = "ONSPD_*/Data/ONSPD_*_UK.csv"


def raw_sources_from_folder(spark: SparkSession, raw_dir: str, officers: str | None = None) -> RawSources:
    """The newest snapshot of each raw source in ``raw_dir`` (S6: chosen by
    the date in the file name, not lexically), read with explicit schemas
    (S1-S3).  ``officers`` optionally names a Parquet input (S5)."""
    from prospect.sources import readers as S

    raw_dir = raw_dir.rstrip("/")
    _, psc_files = S.newest_files(spark, f"{raw_dir}/{PSC_PATTERN}")
    return RawSources(
        companies=S.latest_snapshot(spark, f"{raw_dir}/{COMPANIES_PATTERN}", lambda f: S.scan_companies_csv(spark, f)),
        psc=S.latest_snapshot(spark, f"{raw_dir}/{PSC_PATTERN}", lambda f: S.scan_psc_ndjson(spark, f)),
        postcodes=S.latest_snapshot(spark, f"{raw_dir}/{POSTCODES_PATTERN}", lambda f: S.scan_postcodes_csv(spark, f)),
        officers=S.scan_officers(spark, officers) if officers else None,
        psc_files=tuple(psc_files),
    )


def parsed_once(raw: RawSources) -> RawSources:
    """The sources with the register parsed into a stage table, which the
    prepare stage and the reports then share."""
    if raw.register_parsed:
        return raw
    return replace(raw, companies=materialize(raw.companies, "raw-companies"), register_parsed=True)


def company_locations(companies: DataFrame, postcodes: DataFrame, postcode_rows: int) -> DataFrame:
    """(CompanyNumber, geo_lat, geo_long) for geocodable companies.  The
    postcode side is broadcast only when its counted size fits the budget."""
    small = postcode_rows <= broadcast_row_limit(companies.sparkSession, POSTCODE_ROW_BYTES)
    own = companies.select("CompanyNumber", key_of(companies, "RegAddressPostCode").alias(STORED_KEY))
    placed = geocode_companies(own, postcodes, broadcast_postcodes=small)
    return placed.select("CompanyNumber", F.col("lat").alias("geo_lat"), F.col("long").alias("geo_long"))


def with_location(df: DataFrame, key: str, locations: DataFrame) -> DataFrame:
    """Attach the company's coordinates (left join: rows of companies without
    a location keep NULLs and stay in the table)."""
    loc = locations.withColumnRenamed("CompanyNumber", key) if key != "CompanyNumber" else locations
    return df.join(loc, key, "left")


def write_by_location(df: DataFrame, path: str, partitions: int | None, tiebreak: list[str]) -> None:
    """Range-partition and sort on (geo_lat, geo_long, tie-breakers, row
    hash): row groups cover compact areas.  The tie-breakers and a
    deterministic hash of the whole row let the rows of one hot location (a
    formation agent's postcode) or one hot company spread over several
    partitions instead of landing in one task."""
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_spread")
    keys = [*GEO_COLUMNS, *tiebreak, "_spread"]
    partitions = partitions or output_partitions(df)
    out = df.select("*", spread).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("_spread")
    write_parquet(out, path)


def prepare_all(spark: SparkSession, raw: RawSources, folder: str,
                ingest_as_of: _dt.date | str | None = None, partitions: int | None = None,
                geo_layout: bool = True) -> Tables:
    """Write the prepared tables under ``folder`` and return them as
    Parquet-backed DataFrames.  Without officers an empty officers table is
    written, so that an earlier run's appointments never reach the profiles."""
    folder = folder.rstrip("/")
    parts = partitions  # None: sized per table from its estimate (~256 MB per partition)
    companies_raw = parsed_once(raw).companies
    # Observed after the range exchange: below it, the exchange's sampling
    # pass would be counted too.
    obs = Observation("prepared-postcodes")
    live = with_stored_key(P.prepare_postcodes(raw.postcodes), "pcds")
    postcodes = live.repartitionByRange(parts or output_partitions(live), "lat", "long", "pcds")
    write_parquet(postcodes.observe(obs, F.count(F.lit(1)).alias("rows")), f"{folder}/postcodes.parquet",
                  sort_within=["lat", "long"], bloom=STORED_KEY)
    postcodes, postcode_rows = spark.read.parquet(f"{folder}/postcodes.parquet"), int(obs.get["rows"])

    companies = with_stored_key(P.prepare_companies(companies_raw), "RegAddressPostCode")
    sic = P.prepare_company_sic(companies_raw)
    psc = P.prepare_psc(raw.psc, ingest_as_of)
    officers = P.prepare_officers(raw.officers) if raw.officers is not None else empty_officers(spark)
    if not geo_layout:
        write_parquet(companies, f"{folder}/companies.parquet")
        write_parquet(sic, f"{folder}/company_sic.parquet")
        write_parquet(psc, f"{folder}/psc.parquet")
        write_parquet(officers, f"{folder}/officers.parquet")
        t = read_prepared(spark, folder)
        write_parquet(company_profiles(t.company_sic, t.psc, t.officers), f"{folder}/company_profiles.parquet")
        return read_prepared(spark, folder)

    locations = materialize(company_locations(companies, postcodes, postcode_rows), "company-locations")
    # Partitions are sized before the location join: it adds two columns, not
    # rows, while Catalyst (without column statistics) estimates a join's size
    # as the product of its inputs'.
    write_by_location(with_location(companies, "CompanyNumber", locations), f"{folder}/companies.parquet",
                      parts or output_partitions(companies), ["CompanyNumber"])
    # Searches read owners, officers and industry codes only through the
    # profiles, so these three keep a plain layout.
    write_parquet(sic, f"{folder}/company_sic.parquet")
    write_parquet(psc, f"{folder}/psc.parquet")
    write_parquet(officers, f"{folder}/officers.parquet")
    # Per-company profiles, built once from the written (columnar) tables:
    # searches then join them instead of aggregating at query time.
    t = read_prepared(spark, folder)
    profiles = company_profiles(t.company_sic, t.psc, t.officers)
    write_by_location(with_location(profiles, "CompanyNumber", locations), f"{folder}/company_profiles.parquet",
                      parts or output_partitions(profiles), ["CompanyNumber"])
    t = read_prepared(spark, folder)
    # As wide as both tables: sized from the two scans, not from their join.
    wide = parts or max(output_partitions(t.companies), output_partitions(t.profiles))
    write_by_location(search_table(t.companies, t.profiles), f"{folder}/company_search.parquet", wide, ["CompanyNumber"])
    return read_prepared(spark, folder)


def search_table(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Companies with a location, the columns a result shows, and their profile
    (NULL where a company has no detail row).  A search never reaches the others."""
    located = companies.where(F.col("geo_lat").isNotNull() & F.col("geo_long").isNotNull()).select(*CANDIDATE_COLUMNS, *GEO_COLUMNS)
    return located.join(profiles.drop(*GEO_COLUMNS), "CompanyNumber", "left")


def quality_report(raw: RawSources, prepared: Tables) -> dict[str, DataFrame]:
    """Q1-Q7 over the prepared tables (one aggregate pass each), and Q8 over
    the raw owner lines when their files are known."""
    reports = {
        "company_counts": Q.company_counts(prepared.companies),
        "missing_postcodes": Q.missing_postcodes(prepared.companies),
        "sic_stats": Q.sic_stats(prepared.company_sic),
        "sic_parse_failures": Q.sic_parse_failures(raw.companies),
        "sic_failed_samples": Q.sic_failed_samples(raw.companies),
        "postcode_bounds": Q.postcode_bounds(prepared.postcodes),
        "psc_stats": Q.psc_stats(prepared.psc),
    }
    if raw.psc_files:
        reports["psc_drop_accounting"] = Q.psc_drop_accounting(prepared.psc.sparkSession, list(raw.psc_files))
    return reports


def profile_report(raw: RawSources) -> dict[str, DataFrame]:
    """F2-F10 over the raw sources, before anything is prepared."""
    return {
        "row_counts": PF.row_counts({"companies": raw.companies, "psc": raw.psc, "postcodes": raw.postcodes}),
        "status_topk": PF.status_topk(raw.companies),
        "category_topk": PF.category_topk(raw.companies),
        "psc_sample": PF.psc_sample(raw.psc),
        "kind_breakdown": PF.kind_breakdown(raw.psc),
        "active_vs_ceased": PF.active_vs_ceased(raw.psc),
        "postcode_termination": PF.postcode_termination(raw.postcodes),
        "coordinate_bounds": PF.coordinate_bounds(raw.postcodes),
        "postcode_samples": PF.postcode_samples(raw.postcodes),
    }
