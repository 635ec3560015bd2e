"""Registered queries: one per operator of the inventory, each reading the
driver's tables (through the derived fixtures) at ``sf_dir``, plus the
DuckDB SQL that must give the same rows.

Operators that touch files (sources and sinks) write the derived fixtures
into a fresh folder under the shared checkpoint folder and read them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospect.functions.expressions import round_half_away, year_diff
from prospect.operators import aggregates as A
from prospect.operators import geo as G
from prospect.operators import matching as J
from prospect.operators import output as O
from prospect.operators import predicates as R
from prospect.operators import prepare as P
from prospect.operators import profile as PF
from prospect.operators import quality as Q
from prospect.plans import batch as B
from prospect.plans import oracle as SQL
from prospect.plans.search import SearchRequest, candidates, enriched_matches, find_companies, search, search_unordered
from prospect.session import materialize, scratch_path
from prospect.sources import fixtures as FX
from prospect.sources import readers as S
from prospect.sources import writers as W
from prospect.sources.tables import Tables

AS_OF = "2025-06-30"
TARGET = "AB24 0AQ"
RADIUS = 40.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return FX.fixture_tables(spark, sf_dir, AS_OF)


def basic_request(**kw) -> SearchRequest:
    return SearchRequest(postcode=TARGET, radius_miles=RADIUS, **kw)


def sql_search_kwargs(req: SearchRequest) -> dict:
    return dict(
        postcode=req.postcode, radius=req.radius_miles, status=req.company_status,
        categories=req.account_categories, sic_codes=req.sic_codes,
        min_company_age=req.min_company_age_years, max_company_age=req.max_company_age_years,
        min_psc_age=req.min_psc_age, max_psc_age=req.max_psc_age,
        min_tenure=req.min_psc_tenure_years, max_tenure=req.max_psc_tenure_years,
        strict=bool(req.strict_psc_tenure),
    )


def radius_ctes(**kw) -> str:
    ctes, _ = SQL.search_ctes(postcode=TARGET, radius=RADIUS, **kw)
    return ctes


def _lists_as_text(df: DataFrame) -> DataFrame:
    """Arrays become '|'-joined text for value comparison."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out = out.withColumn(f.name, F.array_join(F.col(f.name).cast("array<string>"), "|"))
    return out


# --- S: sources and sinks ------------------------------------------------------

COMPANY_CSV_SELECT = ", ".join(f'"{n}"' for n in [
    "CompanyName", "CompanyNumber", "RegAddress.PostCode", "CompanyCategory", "CompanyStatus", "CountryOfOrigin",
    "IncorporationDate", "Accounts.AccountCategory", "Accounts.NextDueDate", "Accounts.LastMadeUpDate",
    "ConfStmtNextDueDate", "ConfStmtLastMadeUpDate", "SICCode.SicText_1", "SICCode.SicText_2",
    "SICCode.SicText_3", "SICCode.SicText_4"])


def write_companies_csv(spark: SparkSession, sf_dir: str) -> str:
    """The company fixture as the register's CSV: header names as shipped
    (one with a stray leading blank), dates as dd/MM/yyyy."""
    raw = FX.companies_raw(spark, sf_dir).withColumnRenamed("CompanyNumber", " CompanyNumber")
    path = scratch_path(spark, "BasicCompanyDataAsOneFile-2025-06-01.csv")
    raw.write.option("header", True).option("dateFormat", "dd/MM/yyyy").csv(path)
    return path


def write_psc_ndjson(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "persons-with-significant-control-snapshot-2025-06-01.txt")
    FX.psc_raw(spark, sf_dir).write.option("dateFormat", "yyyy-MM-dd").json(path)
    return path


def write_postcodes_csv(spark: SparkSession, df: DataFrame, folder: str, release: str) -> str:
    path = f"{folder}/ONSPD_{release}/Data/ONSPD_{release}_UK.csv"
    df.write.option("header", True).csv(path)
    return path


@register("scan_companies_csv", SQL.with_fixtures(f"SELECT {COMPANY_CSV_SELECT} FROM companies_raw"))
def q_scan_companies_csv(spark, sf_dir):
    return S.scan_companies_csv(spark, write_companies_csv(spark, sf_dir))


PSC_FLAT_SQL = """SELECT company_number, data_name AS name, data_kind AS kind, data_birth_year AS birth_year,
       data_birth_month AS birth_month, data_nationality AS nationality, data_notified_on AS notified_on,
       data_ceased_on AS ceased_on, n_natures FROM psc_raw"""


def write_dirty_psc(spark: SparkSession, sf_dir: str) -> str:
    """The owner snapshot with lines that a real one can hold besides: cut-off
    objects, blank lines and owners whose ``ceased_on`` is no date."""
    path = scratch_path(spark, "psc-dirty")
    k = F.col("_key")
    whole = FX.psc_raw(spark, sf_dir).select(F.to_json(F.struct("company_number", "data")).alias("value"))
    odd = FX.psc_raw_flat(spark, sf_dir).select("_key")
    ceased = ('{"company_number":"00000001","data":{"kind":"individual-person-with-significant-control",'
              '"date_of_birth":{"year":1960,"month":1},"ceased_on":"not a date"}}')
    lines = whole.unionByName(odd.where(k % 53 == 7).select(F.lit('{"company_number":"0000').alias("value"))).unionByName(
        odd.where(k % 59 == 11).select(F.lit("  ").alias("value"))).unionByName(odd.where(k % 61 == 13).select(F.lit(ceased).alias("value")))
    lines.write.text(path)
    return path


def flatten_psc(df: DataFrame) -> DataFrame:
    d = F.col("data")
    return df.select(
        "company_number", d["name"].alias("name"), d["kind"].alias("kind"),
        d["date_of_birth"]["year"].cast("int").alias("birth_year"),
        d["date_of_birth"]["month"].cast("int").alias("birth_month"),
        d["nationality"].alias("nationality"), d["notified_on"].alias("notified_on"),
        d["ceased_on"].try_cast("date").alias("ceased_on"), F.size(d["natures_of_control"]).alias("n_natures"))


@register("scan_psc_ndjson", SQL.with_fixtures(PSC_FLAT_SQL))
def q_scan_psc_ndjson(spark, sf_dir):
    return flatten_psc(S.scan_psc_ndjson(spark, write_psc_ndjson(spark, sf_dir)))


@register("scan_postcodes_csv", SQL.with_fixtures("SELECT pcds, lat, long, lsoa21, doterm FROM postcodes_raw"))
def q_scan_postcodes_csv(spark, sf_dir):
    folder = scratch_path(spark, "onspd")
    return S.scan_postcodes_csv(spark, write_postcodes_csv(spark, FX.postcodes_raw(spark, sf_dir), folder, "FEB_2025"))


@register("scan_parquet", SQL.with_fixtures(
    "SELECT CompanyNumber, RegAddressPostCode, IncorporationDate FROM companies WHERE CompanyStatus = 'Active'"))
def q_scan_parquet(spark, sf_dir):
    path = scratch_path(spark, "companies.parquet")
    W.write_parquet(tables(spark, sf_dir).companies, path)
    return S.scan_parquet(spark, path).where(F.col("CompanyStatus") == "Active").select(
        "CompanyNumber", "RegAddressPostCode", "IncorporationDate")


@register("scan_officers", SQL.with_fixtures("SELECT company_number, appointment_date FROM officers"))
def q_scan_officers(spark, sf_dir):
    path = scratch_path(spark, "officers.parquet")
    W.write_parquet(tables(spark, sf_dir).officers, path)
    present = S.scan_officers(spark, path)
    absent = S.scan_officers(spark, scratch_path(spark, "missing-officers.parquet"))
    return present.unionByName(absent)


@register("latest_snapshot", SQL.with_fixtures(
    "SELECT pcds, lat, long, lsoa21, doterm, DATE '2025-02-01' AS snapshot_date FROM postcodes_raw"))
def q_latest_snapshot(spark, sf_dir):
    folder = scratch_path(spark, "onspd-releases")
    raw = FX.postcodes_raw(spark, sf_dir)
    write_postcodes_csv(spark, raw.withColumn("lsoa21", F.concat(F.lit("OLD"), "lsoa21")), folder, "NOV_2024")
    write_postcodes_csv(spark, raw, folder, "FEB_2025")
    return S.latest_snapshot(spark, f"{folder}/ONSPD_*/Data/ONSPD_*_UK.csv",
                             lambda files: S.scan_postcodes_csv(spark, files))


@register("write_parquet_roundtrip", SQL.with_fixtures("SELECT * FROM company_sic"))
def q_write_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "company_sic.parquet")
    W.write_parquet(tables(spark, sf_dir).company_sic, path, row_group_rows=1000)
    return spark.read.parquet(path)


def _search_sql_body(req: SearchRequest) -> tuple[str, str]:
    return SQL.search_ctes(**sql_search_kwargs(req))


def search_oracle(req: SearchRequest, order: bool = False, limit: int | None = None) -> str:
    ctes, current = _search_sql_body(req)
    body = SQL.final_select_sql(current)
    if order or limit:
        body += "\nORDER BY distance_miles, CompanyNumber"
    if limit:
        body += f"\nLIMIT {int(limit)}"
    return SQL.with_fixtures(body, ctes)


OUTPUT_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in [
        ("CompanyNumber", T.StringType()), ("CompanyName", T.StringType()), ("Postcode", T.StringType()),
        ("DistanceMiles", T.DoubleType()), ("CompanyStatus", T.StringType()), ("CompanyCategory", T.StringType()),
        ("AccountCategory", T.StringType()), ("IncorporationDate", T.DateType()), ("CompanyAgeYears", T.LongType()),
        ("LastAccountsDate", T.DateType()), ("SicCodeCount", T.LongType()), ("PrimarySicCode", T.IntegerType()),
        ("PrimarySicDescription", T.StringType()), ("PscCount", T.LongType()), ("YoungestPscAge", T.IntegerType()),
        ("OldestPscAge", T.IntegerType()), ("PscLastUpdated", T.DateType()), ("MinPscTenureYears", T.LongType()),
        ("MaxPscTenureYears", T.LongType()), ("AvgPscTenureYears", T.DoubleType()), ("OfficerCount", T.LongType()),
        ("EarliestOfficerAppointment", T.LongType()), ("LatestOfficerAppointment", T.LongType()),
        ("MinOfficerTenureYears", T.LongType()), ("MaxOfficerTenureYears", T.LongType()),
        ("AvgOfficerTenureYears", T.DoubleType()),
    ]
])


@register("write_csv_roundtrip", search_oracle(basic_request()))
def q_write_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "companies-export.csv")
    W.write_csv(search(tables(spark, sf_dir), basic_request(), AS_OF), path)
    return spark.read.option("header", True).schema(OUTPUT_SCHEMA).csv(path)


# --- P: prepare ------------------------------------------------------------------

@register("prepare_companies", SQL.with_fixtures("SELECT * FROM companies"))
def q_prepare_companies(spark, sf_dir):
    return P.prepare_companies(FX.companies_raw(spark, sf_dir))


@register("prepare_company_sic", SQL.with_fixtures("SELECT * FROM company_sic"))
def q_prepare_company_sic(spark, sf_dir):
    return P.prepare_company_sic(FX.companies_raw(spark, sf_dir))


@register("parse_sic_text", SQL.with_fixtures("SELECT * FROM sic_parsed"))
def q_parse_sic_text(spark, sf_dir):
    return P.parse_sic_text(P.sic_texts(FX.companies_raw(spark, sf_dir)))


@register("prepare_postcodes", SQL.with_fixtures("SELECT * FROM postcodes"))
def q_prepare_postcodes(spark, sf_dir):
    return P.prepare_postcodes(FX.postcodes_raw(spark, sf_dir))


@register("prepare_psc", SQL.with_fixtures(
    "SELECT company_number, name, kind, birth_year, approximate_age, nationality, notified_on FROM psc"))
def q_prepare_psc(spark, sf_dir):
    return P.prepare_psc(FX.psc_raw(spark, sf_dir), AS_OF).drop("natures_of_control")


@register("psc_approximate_age", SQL.with_fixtures(
    f"""SELECT company_number, data_name AS name, data_birth_year AS birth_year,
       CAST(YEAR({SQL.AS_OF}) - data_birth_year AS INTEGER) AS approximate_age
FROM psc_raw WHERE data_birth_year IS NOT NULL"""))
def q_psc_approximate_age(spark, sf_dir):
    flat = FX.psc_raw_flat(spark, sf_dir).where(F.col("data_birth_year").isNotNull())
    return flat.select("company_number", F.col("data_name").alias("name"), F.col("data_birth_year").alias("birth_year"),
                       P.psc_approximate_age(F.col("data_birth_year"), AS_OF).alias("approximate_age"))


# --- Q: data quality ----------------------------------------------------------------

@register("dq_company_counts", SQL.with_fixtures(
    "SELECT COUNT(*) AS total_companies, COUNT(*) FILTER (WHERE CompanyStatus = 'Active') AS active_companies FROM companies"))
def q_dq_company_counts(spark, sf_dir):
    return Q.company_counts(tables(spark, sf_dir).companies)


@register("dq_missing_postcodes", SQL.with_fixtures(
    "SELECT COUNT(*) FILTER (WHERE CompanyStatus = 'Active' AND RegAddressPostCode IS NULL) AS active_without_postcode FROM companies"))
def q_dq_missing_postcodes(spark, sf_dir):
    return Q.missing_postcodes(tables(spark, sf_dir).companies)


@register("dq_sic_stats", SQL.with_fixtures(
    "SELECT COUNT(*) AS mappings, COUNT(DISTINCT sic_code) AS unique_codes, COUNT(DISTINCT CompanyNumber) AS companies_with_sic FROM company_sic"))
def q_dq_sic_stats(spark, sf_dir):
    return Q.sic_stats(tables(spark, sf_dir).company_sic)


@register("dq_sic_parse_failures", SQL.with_fixtures(
    """SELECT total_fields, parsed_codes, total_fields - parsed_codes AS failed_codes,
       (total_fields - parsed_codes) / total_fields * 100 AS failed_pct
FROM (SELECT (SELECT COUNT(*) FROM sic_text) AS total_fields, (SELECT COUNT(*) FROM company_sic) AS parsed_codes)"""))
def q_dq_sic_parse_failures(spark, sf_dir):
    return Q.sic_parse_failures(FX.companies_raw(spark, sf_dir))


@register("dq_sic_failed_samples", SQL.with_fixtures(
    """SELECT "CompanyNumber" AS CompanyNumber, "SICCode.SicText_1" AS sic_text FROM companies_raw
WHERE "SICCode.SicText_1" IS NOT NULL AND TRY_CAST(SPLIT_PART("SICCode.SicText_1", ' - ', 1) AS INTEGER) IS NULL
ORDER BY CompanyNumber LIMIT 5"""))
def q_dq_sic_failed_samples(spark, sf_dir):
    return Q.sic_failed_samples(FX.companies_raw(spark, sf_dir), 5)


@register("dq_postcode_bounds", SQL.with_fixtures(
    """SELECT COUNT(*) AS postcodes, MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(long) AS min_long, MAX(long) AS max_long,
       (MIN(lat) >= 49 AND MAX(lat) <= 61) AS lat_within_uk, (MIN(long) >= -8 AND MAX(long) <= 2) AS long_within_uk
FROM postcodes"""))
def q_dq_postcode_bounds(spark, sf_dir):
    return Q.postcode_bounds(tables(spark, sf_dir).postcodes)


@register("dq_psc_stats", SQL.with_fixtures(
    """SELECT COUNT(*) AS psc_count, COUNT(DISTINCT company_number) AS companies_with_psc,
       MIN(approximate_age) AS min_age, AVG(approximate_age) AS avg_age, MAX(approximate_age) AS max_age FROM psc"""))
def q_dq_psc_stats(spark, sf_dir):
    return Q.psc_stats(tables(spark, sf_dir).psc)


@register("dq_psc_drop_accounting", SQL.with_fixtures(
    """SELECT total_lines, parsed_records, total_lines - parsed_records AS dropped,
       (total_lines - parsed_records) / total_lines * 100 AS dropped_pct,
       blank, malformed, non_individual, ceased, missing_birth_year
FROM (SELECT COUNT(*) + COUNT(*) FILTER (WHERE o % 53 = 7) + COUNT(*) FILTER (WHERE o % 59 = 11) + COUNT(*) FILTER (WHERE o % 61 = 13) AS total_lines,
             COUNT(*) FILTER (WHERE o % 53 = 7) AS malformed, COUNT(*) FILTER (WHERE o % 59 = 11) AS blank,
             COUNT(*) FILTER (WHERE data_kind = 'individual-person-with-significant-control' AND data_ceased_on IS NULL AND data_birth_year IS NOT NULL) AS parsed_records,
             COUNT(*) FILTER (WHERE data_kind IS DISTINCT FROM 'individual-person-with-significant-control') AS non_individual,
             COUNT(*) FILTER (WHERE data_kind = 'individual-person-with-significant-control' AND data_ceased_on IS NOT NULL)
               + COUNT(*) FILTER (WHERE o % 61 = 13) AS ceased,
             COUNT(*) FILTER (WHERE data_kind = 'individual-person-with-significant-control' AND data_ceased_on IS NULL AND data_birth_year IS NULL) AS missing_birth_year
      FROM (SELECT *, CAST(replace(data_name, 'Person ', '') AS BIGINT) AS o FROM psc_raw))"""))
def q_dq_psc_drop_accounting(spark, sf_dir):
    return Q.psc_drop_accounting(spark, write_dirty_psc(spark, sf_dir))


@register("prepare_psc_dirty", SQL.with_fixtures(
    "SELECT COUNT(*) AS kept, COUNT(*) AS parsed_records FROM psc"))
def q_prepare_psc_dirty(spark, sf_dir):
    """Rows kept by the prepare rule, next to the report's number, on a
    snapshot with malformed, blank and unreadable lines."""
    path = write_dirty_psc(spark, sf_dir)
    kept = P.prepare_psc(S.scan_psc_ndjson(spark, path), AS_OF).agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(Q.psc_drop_accounting(spark, path).select("parsed_records"))


# --- F: profiling of raw sources ------------------------------------------------------

@register("profile_schema", SQL.with_fixtures(
    """SELECT position, column_name, data_type FROM (
  SELECT row_number() OVER () AS position, column_name, column_type AS data_type
  FROM (DESCRIBE SELECT * FROM companies_raw)) WHERE position <= 20"""))
def q_profile_schema(spark, sf_dir):
    return PF.schema_preview(S.scan_companies_csv(spark, write_companies_csv(spark, sf_dir)), 20)


@register("profile_row_counts", SQL.with_fixtures(
    """SELECT 'companies' AS source, COUNT(*) AS row_count FROM companies_raw
UNION ALL SELECT 'psc', COUNT(*) FROM psc_raw
UNION ALL SELECT 'postcodes', COUNT(*) FROM postcodes_raw"""))
def q_profile_row_counts(spark, sf_dir):
    return PF.row_counts({
        "companies": FX.companies_raw(spark, sf_dir),
        "psc": FX.psc_raw(spark, sf_dir),
        "postcodes": FX.postcodes_raw(spark, sf_dir),
    })


@register("profile_status_topk", SQL.with_fixtures(
    """SELECT "CompanyStatus" AS CompanyStatus, COUNT(*) AS companies FROM companies_raw
GROUP BY 1 ORDER BY companies DESC, CompanyStatus LIMIT 10"""))
def q_profile_status_topk(spark, sf_dir):
    return PF.status_topk(FX.companies_raw(spark, sf_dir), 10)


@register("profile_category_topk", SQL.with_fixtures(
    """SELECT "Accounts.AccountCategory" AS category, COUNT(*) AS companies FROM companies_raw
WHERE "Accounts.AccountCategory" IS NOT NULL GROUP BY 1 ORDER BY companies DESC, category LIMIT 10"""))
def q_profile_category_topk(spark, sf_dir):
    return PF.category_topk(FX.companies_raw(spark, sf_dir), 10)


@register("profile_psc_sample", SQL.with_fixtures(PSC_FLAT_SQL + " ORDER BY company_number, name LIMIT 1"))
def q_profile_psc_sample(spark, sf_dir):
    return flatten_psc(PF.psc_sample(FX.psc_raw(spark, sf_dir)))


@register("profile_kind_breakdown", SQL.with_fixtures(
    """SELECT COALESCE(replace(replace(data_kind, 'individual-', ''), '-with-significant-control', ''), 'NULL') AS kind_short,
       COUNT(*) AS records FROM psc_raw GROUP BY data_kind"""))
def q_profile_kind_breakdown(spark, sf_dir):
    return PF.kind_breakdown(FX.psc_raw(spark, sf_dir))


@register("profile_active_ceased", SQL.with_fixtures(
    """SELECT CASE WHEN data_ceased_on IS NULL THEN 'Active' ELSE 'Ceased' END AS status, COUNT(*) AS records
FROM psc_raw WHERE data_kind = 'individual-person-with-significant-control' GROUP BY 1"""))
def q_profile_active_ceased(spark, sf_dir):
    return PF.active_vs_ceased(FX.psc_raw(spark, sf_dir))


@register("profile_postcode_termination", SQL.with_fixtures(
    """SELECT CASE WHEN doterm IS NULL THEN 'Active' ELSE 'Terminated' END AS status, COUNT(*) AS postcodes
FROM postcodes_raw GROUP BY 1"""))
def q_profile_postcode_termination(spark, sf_dir):
    return PF.postcode_termination(FX.postcodes_raw(spark, sf_dir))


@register("profile_coordinate_bounds", SQL.with_fixtures(
    """SELECT MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(long) AS min_long, MAX(long) AS max_long,
       (MIN(lat) >= 49 AND MAX(lat) <= 61) AS lat_within_uk, (MIN(long) >= -8 AND MAX(long) <= 2) AS long_within_uk
FROM postcodes_raw WHERE doterm IS NULL AND lat IS NOT NULL AND long IS NOT NULL"""))
def q_profile_coordinate_bounds(spark, sf_dir):
    return PF.coordinate_bounds(FX.postcodes_raw(spark, sf_dir))


@register("profile_postcode_samples", SQL.with_fixtures(
    "SELECT pcds, lat, long FROM postcodes_raw WHERE doterm IS NULL AND lat IS NOT NULL ORDER BY pcds LIMIT 5"))
def q_profile_postcode_samples(spark, sf_dir):
    return PF.postcode_samples(FX.postcodes_raw(spark, sf_dir), 5)


# --- G: geography --------------------------------------------------------------------------

@register("normalise_postcode", SQL.with_fixtures(
    "SELECT CompanyNumber, RegAddressPostCode, REPLACE(UPPER(RegAddressPostCode), ' ', '') AS normalised_postcode FROM companies"))
def q_normalise_postcode(spark, sf_dir):
    c = tables(spark, sf_dir).companies
    return G.normalise_postcodes(c, "RegAddressPostCode", "normalised_postcode").select(
        "CompanyNumber", "RegAddressPostCode", "normalised_postcode")


@register("postcode_lookup", SQL.with_fixtures(
    "SELECT pcds, lat, long FROM postcodes WHERE REPLACE(UPPER(pcds), ' ', '') = 'AB240AQ' ORDER BY pcds LIMIT 1"))
def q_postcode_lookup(spark, sf_dir):
    return G.postcode_lookup(tables(spark, sf_dir).postcodes, "ab24 0aq")


@register("geocode_companies", SQL.with_fixtures(
    """SELECT c.CompanyNumber, c.RegAddressPostCode, p.lat, p.long FROM companies c
JOIN postcodes p ON REPLACE(UPPER(c.RegAddressPostCode), ' ', '') = REPLACE(UPPER(p.pcds), ' ', '')"""))
def q_geocode_companies(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.geocode_companies(t.companies, t.postcodes).select("CompanyNumber", "RegAddressPostCode", "lat", "long")


TARGET_CTE = ("target AS (SELECT lat AS t_lat, long AS t_lon FROM postcodes "
              "WHERE REPLACE(UPPER(pcds), ' ', '') = 'AB240AQ' ORDER BY pcds LIMIT 1)")


def _target(spark, sf_dir, t: Tables | None = None):
    t = t or tables(spark, sf_dir)
    lat0, lon0, _ = G.lookup_target(t.postcodes, TARGET)
    return t, lat0, lon0


@register("haversine_distance", SQL.with_fixtures(
    f"SELECT p.pcds, ROUND({SQL.haversine_sql('t.t_lat', 't.t_lon')}, 6) AS distance_miles FROM postcodes p CROSS JOIN target t",
    TARGET_CTE))
def q_haversine_distance(spark, sf_dir):
    # Raw doubles can differ in the last bit between the JVM's and C's
    # trigonometry; six decimals (a tenth of an inch) compare exactly.
    t, lat0, lon0 = _target(spark, sf_dir)
    return G.haversine_distance(t.postcodes, lat0, lon0).select(
        "pcds", round_half_away("distance_miles", 6).alias("distance_miles"))


@register("radius_filter", SQL.with_fixtures(
    f"""SELECT pcds, ROUND(distance_miles, 6) AS distance_miles FROM (
  SELECT p.pcds, {SQL.haversine_sql('t.t_lat', 't.t_lon')} AS distance_miles FROM postcodes p CROSS JOIN target t)
WHERE distance_miles <= {RADIUS}""", TARGET_CTE))
def q_radius_filter(spark, sf_dir):
    t, lat0, lon0 = _target(spark, sf_dir)
    return G.radius_filter(t.postcodes, lat0, lon0, RADIUS).select(
        "pcds", round_half_away("distance_miles", 6).alias("distance_miles"))


# --- R: row predicates ----------------------------------------------------------------------

@register("filter_status", SQL.with_fixtures(
    "SELECT CompanyNumber, CompanyStatus FROM companies WHERE CompanyStatus = 'Liquidation'"))
def q_filter_status(spark, sf_dir):
    return R.filter_status(tables(spark, sf_dir).companies, "Liquidation").select("CompanyNumber", "CompanyStatus")


@register("filter_account_category", SQL.with_fixtures(
    "SELECT CompanyNumber, AccountCategory FROM companies WHERE AccountCategory IN ('MICRO ENTITY', 'SMALL')"))
def q_filter_account_category(spark, sf_dir):
    return R.filter_account_category(tables(spark, sf_dir).companies, ["MICRO ENTITY", "SMALL"]).select(
        "CompanyNumber", "AccountCategory")


@register("filter_default_non_dormant", SQL.with_fixtures(
    "SELECT CompanyNumber, AccountCategory FROM companies WHERE AccountCategory != 'DORMANT' OR AccountCategory IS NULL"))
def q_filter_default_non_dormant(spark, sf_dir):
    return R.filter_default_non_dormant(tables(spark, sf_dir).companies).select("CompanyNumber", "AccountCategory")


@register("filter_company_age", SQL.with_fixtures(
    f"""SELECT CompanyNumber, IncorporationDate, (YEAR({SQL.AS_OF}) - YEAR(IncorporationDate)) AS CompanyAgeYears
FROM companies WHERE (YEAR({SQL.AS_OF}) - YEAR(IncorporationDate)) >= 10 AND (YEAR({SQL.AS_OF}) - YEAR(IncorporationDate)) <= 40"""))
def q_filter_company_age(spark, sf_dir):
    c = R.filter_company_age(tables(spark, sf_dir).companies, AS_OF, 10, 40)
    return c.select("CompanyNumber", "IncorporationDate",
                    year_diff(F.lit(AS_OF).cast("date"), "IncorporationDate").alias("CompanyAgeYears"))


# --- A: aggregates ---------------------------------------------------------------------------

@register("sic_aggregates", SQL.with_fixtures("SELECT * FROM sic_facts", radius_ctes()))
def q_sic_aggregates(spark, sf_dir):
    return A.sic_aggregates(tables(spark, sf_dir).company_sic)


@register("psc_aggregates", SQL.with_fixtures("SELECT * FROM psc_facts", radius_ctes()))
def q_psc_aggregates(spark, sf_dir):
    return A.psc_aggregates(tables(spark, sf_dir).psc, AS_OF)


@register("officer_aggregates", SQL.with_fixtures("SELECT * FROM officer_facts", radius_ctes()))
def q_officer_aggregates(spark, sf_dir):
    return A.officer_aggregates(tables(spark, sf_dir).officers, AS_OF)


@register("yyyymmdd_year", SQL.with_fixtures(
    """SELECT company_number, appointment_date,
       CAST(SUBSTR(CAST(appointment_date AS VARCHAR), 1, 4) AS INTEGER) AS appointment_year FROM officers"""))
def q_yyyymmdd_year(spark, sf_dir):
    from prospect.functions.expressions import yyyymmdd_year

    o = tables(spark, sf_dir).officers
    return o.select("company_number", "appointment_date", yyyymmdd_year("appointment_date").alias("appointment_year"))


def _set_text(col: str):
    s = F.col(col)
    return F.when(F.size(s) > 0, F.array_join(F.array_sort(s).cast("array<string>"), "|")).alias(col)


PROFILE_SCALARS = ["CompanyNumber", "primary_sic_code", "primary_sic_description", "psc_count", "youngest_psc_age",
                   "oldest_psc_age", "psc_last_updated", "psc_year_min", "psc_year_max", "psc_year_sum", "psc_year_n",
                   "officer_count", "earliest_officer_appointment", "latest_officer_appointment", "officer_year_min",
                   "officer_year_max", "officer_year_sum", "officer_year_n"]
PROFILE_SETS = ["sic_code_set", "psc_age_set", "psc_year_set", "officer_year_set"]
_OFF_YEAR = "CAST(SUBSTR(CAST(appointment_date AS VARCHAR), 1, 4) AS INTEGER)"


def _sql_set(expr: str, name: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(list({expr}) FILTER (WHERE {expr} IS NOT NULL))), '|') "
            f"AS {name}")


@register("company_profiles", SQL.with_fixtures(f"""
SELECT CompanyNumber,
       MAX(CASE WHEN sic_position = 1 THEN sic_code END) AS primary_sic_code,
       MAX(CASE WHEN sic_position = 1 THEN sic_description END) AS primary_sic_description,
       COUNT(*) FILTER (WHERE kind = 'P') AS psc_count,
       MIN(approximate_age) AS youngest_psc_age, MAX(approximate_age) AS oldest_psc_age,
       MAX(notified_on) AS psc_last_updated,
       CAST(MIN(YEAR(notified_on)) AS INTEGER) AS psc_year_min, CAST(MAX(YEAR(notified_on)) AS INTEGER) AS psc_year_max,
       CAST(SUM(YEAR(notified_on)) AS BIGINT) AS psc_year_sum, COUNT(notified_on) AS psc_year_n,
       COUNT(*) FILTER (WHERE kind = 'O') AS officer_count,
       MIN(appointment_date) AS earliest_officer_appointment, MAX(appointment_date) AS latest_officer_appointment,
       MIN({_OFF_YEAR}) AS officer_year_min, MAX({_OFF_YEAR}) AS officer_year_max,
       CAST(SUM({_OFF_YEAR}) AS BIGINT) AS officer_year_sum, COUNT(appointment_date) AS officer_year_n,
       {_sql_set('sic_code', 'sic_code_set')}, {_sql_set('approximate_age', 'psc_age_set')},
       {_sql_set('CAST(YEAR(notified_on) AS INTEGER)', 'psc_year_set')}, {_sql_set(_OFF_YEAR, 'officer_year_set')}
FROM (
  SELECT CompanyNumber, 'S' AS kind, sic_code, sic_position, sic_description,
         CAST(NULL AS INTEGER) AS approximate_age, CAST(NULL AS DATE) AS notified_on, CAST(NULL AS BIGINT) AS appointment_date
  FROM company_sic
  UNION ALL SELECT company_number, 'P', NULL, NULL, NULL, approximate_age, notified_on, NULL FROM psc
  UNION ALL SELECT company_number, 'O', NULL, NULL, NULL, NULL, NULL, appointment_date FROM officers
  WHERE appointment_date IS NOT NULL)
GROUP BY CompanyNumber"""))
def q_company_profiles(spark, sf_dir):
    t = tables(spark, sf_dir)
    prof = A.company_profiles(t.company_sic, t.psc, t.officers)
    prof = prof.withColumns({"psc_age_set": A.bit_values(A.AGE_BITS, "psc_ages"), "psc_year_set": A.bit_values(A.YEAR_BITS, "psc_years"),
                             "officer_year_set": A.bit_values(A.YEAR_BITS, "officer_years")})
    return prof.select(*PROFILE_SCALARS, *[_set_text(c) for c in PROFILE_SETS])


ENRICHED_COLUMNS = ["CompanyNumber", *A.SIC_COLUMNS, *A.PSC_COLUMNS, *A.OFFICER_COLUMNS]


@register("enrich_companies", SQL.with_fixtures(
    f"SELECT {', '.join(ENRICHED_COLUMNS)} FROM in_reach", radius_ctes()))
def q_enrich_companies(spark, sf_dir):
    t, lat0, lon0 = _target(spark, sf_dir)
    req = basic_request()
    base = materialize(candidates(t, req, (lat0, lon0), AS_OF))
    return enriched_matches(t, req, base, base.count(), AS_OF).select(*ENRICHED_COLUMNS)


# --- J: one-to-many filters -------------------------------------------------------------------

def _radius_base(spark, sf_dir):
    t, lat0, lon0 = _target(spark, sf_dir)
    return t, candidates(t, basic_request(), (lat0, lon0), AS_OF)


def _j_oracle(where_sql: str, join_psc: bool = False) -> str:
    src = "in_reach c" + (" INNER JOIN psc p ON c.CompanyNumber = p.company_number" if join_psc else "")
    return SQL.with_fixtures(f"SELECT DISTINCT c.CompanyNumber, c.CompanyName FROM {src} WHERE {where_sql}",
                             radius_ctes())


Y = f"YEAR({SQL.AS_OF})"
OFF_TENURE = f"({Y} - CAST(SUBSTR(CAST(o.appointment_date AS VARCHAR), 1, 4) AS INTEGER))"


@register("filter_sic_any", _j_oracle(
    "EXISTS (SELECT 1 FROM company_sic s WHERE s.CompanyNumber = c.CompanyNumber AND s.sic_code IN (62020, 62090))"))
def q_filter_sic_any(spark, sf_dir):
    t, base = _radius_base(spark, sf_dir)
    return J.filter_sic_any(base, t.company_sic, [62020, 62090]).select("CompanyNumber", "CompanyName")


@register("filter_psc_age_any", _j_oracle("p.approximate_age >= 60 AND p.approximate_age <= 75", join_psc=True))
def q_filter_psc_age_any(spark, sf_dir):
    t, base = _radius_base(spark, sf_dir)
    return J.filter_psc_age_any(base, t.psc, 60, 75).select("CompanyNumber", "CompanyName")


@register("filter_psc_tenure_any", _j_oracle(
    f"""({Y} - YEAR(p.notified_on)) >= 5 AND ({Y} - YEAR(p.notified_on)) <= 15
AND EXISTS (SELECT 1 FROM officers o WHERE c.CompanyNumber = o.company_number AND o.appointment_date IS NOT NULL
            AND {OFF_TENURE} BETWEEN 5 AND 15)""", join_psc=True))
def q_filter_psc_tenure_any(spark, sf_dir):
    t, base = _radius_base(spark, sf_dir)
    return J.filter_psc_tenure_any(base, t.psc, t.officers, AS_OF, 5, 15).select("CompanyNumber", "CompanyName")


@register("filter_psc_tenure_strict", _j_oracle(
    f"""NOT EXISTS (SELECT 1 FROM psc p WHERE c.CompanyNumber = p.company_number AND NOT (({Y} - YEAR(p.notified_on)) >= 5))
AND EXISTS (SELECT 1 FROM officers o WHERE c.CompanyNumber = o.company_number AND o.appointment_date IS NOT NULL)"""))
def q_filter_psc_tenure_strict(spark, sf_dir):
    t, base = _radius_base(spark, sf_dir)
    return J.filter_psc_tenure_strict(base, t.psc, t.officers, AS_OF, 5, None).select("CompanyNumber", "CompanyName")


@register("filter_has_dated_officer", _j_oracle(
    "EXISTS (SELECT 1 FROM officers o WHERE c.CompanyNumber = o.company_number AND o.appointment_date IS NOT NULL)"))
def q_filter_has_dated_officer(spark, sf_dir):
    t, base = _radius_base(spark, sf_dir)
    return J.filter_has_dated_officer(base, t.officers).select("CompanyNumber", "CompanyName")


@register("filter_officer_tenure_any", _j_oracle(
    f"""EXISTS (SELECT 1 FROM officers o WHERE c.CompanyNumber = o.company_number AND o.appointment_date IS NOT NULL
            AND {OFF_TENURE} BETWEEN 5 AND 15)"""))
def q_filter_officer_tenure_any(spark, sf_dir):
    t, base = _radius_base(spark, sf_dir)
    return J.filter_officer_tenure_any(base, t.officers, AS_OF, 5, 15).select("CompanyNumber", "CompanyName")


# --- O: output and whole searches --------------------------------------------------------------

SEARCHES = {
    "search_basic": basic_request(),
    "search_all_filters": basic_request(sic_codes=(62020, 62090), min_company_age_years=5, min_psc_age=60),
    "search_sic": basic_request(sic_codes=(62020, 62090)),
    "search_psc_age": basic_request(min_psc_age=60, max_psc_age=75),
    "search_psc_age_default_bound": basic_request(min_psc_age=16),
    "search_tenure_any": basic_request(min_psc_tenure_years=5, max_psc_tenure_years=15),
    "search_tenure_strict": basic_request(min_psc_tenure_years=5, strict_psc_tenure=True),
    "search_categories": basic_request(account_categories=("MICRO ENTITY", "SMALL"),
                                       min_company_age_years=10, max_company_age_years=40),
    "search_dissolved_wide": SearchRequest(postcode="ab300aq", radius_miles=60.0, company_status="Dissolved",
                                           account_categories=("DORMANT", "SMALL")),
}


def _search_query(req: SearchRequest):
    def run(spark, sf_dir):
        return search(tables(spark, sf_dir), req, AS_OF)
    return run


for _name, _req in SEARCHES.items():
    register(_name, search_oracle(_req))(_search_query(_req))


@register("final_projection", search_oracle(basic_request()))
def q_final_projection(spark, sf_dir):
    return search_unordered(tables(spark, sf_dir), basic_request(), AS_OF).drop("distance_miles")


def _ranked_oracle(req: SearchRequest, page_size: int | None = None) -> str:
    ctes, current = _search_sql_body(req)
    body = SQL.final_select_sql(current).replace(
        "SELECT CompanyNumber,",
        "SELECT row_number() OVER (ORDER BY distance_miles, CompanyNumber) AS row_in_result, CompanyNumber,", 1)
    if page_size:
        body = f"SELECT *, (row_in_result - 1) // {page_size} AS page FROM ({body})"
    return SQL.with_fixtures(body, ctes)


@register("order_by_distance", _ranked_oracle(basic_request()))
def q_order_by_distance(spark, sf_dir):
    res = search_unordered(tables(spark, sf_dir), basic_request(), AS_OF)
    ordered = O.order_by_distance(res).withColumn("_at", F.monotonically_increasing_id())
    # The position in the ordered result, for the comparison.
    return O.result_pages(ordered, page_size=1 << 30, order_keys=["_at"]).drop("page", "distance_miles", "_at")


@register("result_count", SQL.with_fixtures(
    f"SELECT COUNT(*) AS result_count FROM ({SQL.final_select_sql(_search_sql_body(basic_request())[1])})",
    _search_sql_body(basic_request())[0]))
def q_result_count(spark, sf_dir):
    res = search_unordered(tables(spark, sf_dir), basic_request(), AS_OF)
    return res.agg(F.count(F.lit(1)).alias("result_count"))


@register("nearest_top_n", search_oracle(basic_request(), limit=25))
def q_nearest_top_n(spark, sf_dir):
    res = search_unordered(tables(spark, sf_dir), basic_request(), AS_OF)
    return O.nearest_top_n(res, 25).drop("distance_miles")


@register("result_pages", _ranked_oracle(basic_request(), page_size=50))
def q_result_pages(spark, sf_dir):
    res = search_unordered(tables(spark, sf_dir), basic_request(), AS_OF)
    return O.result_pages(res, page_size=50).drop("distance_miles")


FIND_REQUEST = basic_request(sic_codes=(62020, 62090), min_company_age_years=5, min_psc_age=60, max_results=30)


@register("find_companies", search_oracle(FIND_REQUEST, limit=30))
def q_find_companies(spark, sf_dir):
    path = scratch_path(spark, "find-companies.csv")
    _, count = find_companies(tables(spark, sf_dir), FIND_REQUEST, AS_OF, output_path=path)
    if count == 0:
        return spark.createDataFrame([], OUTPUT_SCHEMA)
    return spark.read.option("header", True).schema(OUTPUT_SCHEMA).csv(path)


# --- B: many requests -----------------------------------------------------------------------------

def requests_and_profiles(spark, sf_dir):
    return FX.requests_raw(spark, sf_dir), FX.profiles(spark, sf_dir)


def run_batch(spark, sf_dir):
    t = tables(spark, sf_dir)
    reqs, profs = requests_and_profiles(spark, sf_dir)
    return t, B.run_requests(t, reqs, profs, AS_OF)


RESOLVED_COLUMNS = ["request_id", "profile", "postcode", "radius_miles", "company_status", "account_categories",
                    "sic_codes", "min_company_age_years", "max_company_age_years", "min_psc_age", "max_psc_age",
                    "min_psc_tenure_years", "max_psc_tenure_years", "strict_psc_tenure", "output_format",
                    "max_results", "profile_found"]


@register("resolve_requests", SQL.with_fixtures(
    "SELECT " + ", ".join(
        f"array_to_string({c}, '|') AS {c}" if c in ("account_categories", "sic_codes") else c
        for c in RESOLVED_COLUMNS) + " FROM resolved", SQL.REQUEST_CTES))
def q_resolve_requests(spark, sf_dir):
    reqs, profs = requests_and_profiles(spark, sf_dir)
    return _lists_as_text(B.resolve_requests(reqs, profs).select(*RESOLVED_COLUMNS))


@register("validate_requests", SQL.with_fixtures(
    "SELECT request_id, is_valid, message FROM validated", SQL.REQUEST_CTES))
def q_validate_requests(spark, sf_dir):
    reqs, profs = requests_and_profiles(spark, sf_dir)
    return B.validate_requests(B.resolve_requests(reqs, profs)).select("request_id", "is_valid", "message")


@register("search_many", SQL.with_fixtures(
    "SELECT request_id, CompanyNumber, ROUND(distance_miles, 2) AS DistanceMiles FROM many_pairs",
    SQL.REQUEST_CTES + ",\n" + SQL.MANY_CTES))
def q_search_many(spark, sf_dir):
    t = tables(spark, sf_dir)
    reqs, profs = requests_and_profiles(spark, sf_dir)
    located = B.locate_requests(B.validate_requests(B.resolve_requests(reqs, profs)), t.postcodes)
    pairs = B.search_many(t, materialize(located), AS_OF)
    return pairs.select("request_id", "CompanyNumber", round_half_away("distance_miles", 2).alias("DistanceMiles"))


@register("search_many_filters", SQL.with_fixtures(
    "SELECT * EXCLUDE (max_results, distance_miles, rn) FROM many_results", SQL.REQUEST_CTES + ",\n" + SQL.MANY_CTES))
def q_search_many_filters(spark, sf_dir):
    _, (_, _, results, _) = run_batch(spark, sf_dir)
    return results


@register("search_many_counts", SQL.with_fixtures(
    "SELECT request_id, outcome, message, match_count FROM many_counts", SQL.REQUEST_CTES + ",\n" + SQL.MANY_CTES))
def q_search_many_counts(spark, sf_dir):
    _, (_, _, _, counts) = run_batch(spark, sf_dir)
    return counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
