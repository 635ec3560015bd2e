"""Raw sources derived from the driver's TPC-H-style tables.

The reference ships no data, so the four raw inputs are derived, row for
row, from tables that grow with the scale factor:

* company register rows      <- ``customer``
* postcode directory rows    <- ``part``
* owner (PSC) records        <- ``orders``
* officer appointments       <- ``lineitem`` joined to ``orders``
* search profiles / requests <- ``nation`` / ``supplier``

Each derivation plants the awkward cases the reference must handle (NULL and
unknown postcodes, odd spellings, unparsable industry codes, corporate and
ceased owners, missing dates, companies without owners or officers, invalid
requests).  The same rules are written as SQL in ``prospect.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tpch(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def synthetic_postcode(key: Column) -> Column:
    """``AB<10..99> <digit><letter>Q`` from an integer key (same rule for
    companies, postcodes and request targets so that they meet).  The area and
    the last letter go on where the inner letter ends, so keys up to 400
    million have codes of their own."""
    def letter(index: Column) -> Column:
        return F.substr(F.lit(LETTERS), (F.lit(1) + index % 26).cast("int"), F.lit(1))

    area = (F.lit(1) + F.floor(key / 23400).cast("bigint")) % 676
    return F.concat(
        letter(F.floor(area / 26).cast("bigint")),
        letter(area),
        (F.lit(10) + key % 90).cast("string"),
        F.lit(" "),
        (F.floor(key / 90).cast("bigint") % 10).cast("string"),
        letter(F.floor(key / 900).cast("bigint")),
        letter(F.lit(16) + F.floor(key / 15818400).cast("bigint")),
    )


def padded_number(key: Column) -> Column:
    return F.lpad(key.cast("string"), 8, "0")


def unregistered_number(key: Column) -> Column:
    """A company number the register does not contain ('N' + 7 digits)."""
    return F.concat(F.lit("N"), F.lpad(key.cast("string"), 7, "0"))


def companies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company register rows, named as in the register's CSV header."""
    c = tpch(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pc = synthetic_postcode(k)
    postcode = (
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(k % 23 == 0, F.lit("ZZ99 9ZZ"))
        .when(k % 3 == 0, F.lower(pc))
        .when(k % 3 == 1, F.replace(pc, F.lit(" "), F.lit("")))
        .otherwise(pc)
    )
    status = (
        F.when(k % 10 < 7, F.lit("Active"))
        .when(k % 10 == 7, F.lit("Dissolved"))
        .when(k % 10 == 8, F.lit("Liquidation"))
        .otherwise(F.lit("Administration"))
    )
    incorporated = F.when(k % 29 == 0, F.lit(None).cast("date")).otherwise(
        F.make_date((F.lit(1950) + k * 11 % 74).cast("int"), (F.lit(1) + k % 12).cast("int"), (F.lit(1) + k % 28).cast("int"))
    )
    nk = F.col("c_nationkey") % 8
    category = (
        F.when(nk == 0, "MICRO ENTITY").when(nk == 1, "SMALL").when(nk == 2, "MEDIUM").when(nk == 3, "FULL")
        .when(nk == 4, "DORMANT").when(nk == 5, "NO ACCOUNTS FILED").when(nk == 6, "TOTAL EXEMPTION FULL")
        .otherwise(F.lit(None).cast("string"))
    )
    m = (F.lit(1) + k % 12).cast("int")
    sic1 = (
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 11 == 0, F.lit("None Supplied"))
        .when(k % 5 == 0, F.lit("62020 - Information technology consultancy activities"))
        .when(k % 5 == 1, F.lit("43220 - Plumbing, heat and air-conditioning installation"))
        .when(k % 5 == 2, F.lit("01110 - Growing of cereals - except rice"))
        .when(k % 5 == 3, F.lit("71121 - Engineering design activities"))
        .otherwise(F.lit("73110 - Advertising agencies"))
    )
    return c.select(
        F.col("c_name").alias("CompanyName"),
        padded_number(k).alias("CompanyNumber"),
        postcode.alias("RegAddress.PostCode"),
        F.col("c_mktsegment").alias("CompanyCategory"),
        status.alias("CompanyStatus"),
        F.lit("United Kingdom").alias("CountryOfOrigin"),
        incorporated.alias("IncorporationDate"),
        category.alias("Accounts.AccountCategory"),
        F.make_date((F.lit(2025) + k % 2).cast("int"), m, F.lit(28)).alias("Accounts.NextDueDate"),
        F.make_date((F.lit(2022) + k % 3).cast("int"), m, F.lit(28)).alias("Accounts.LastMadeUpDate"),
        F.make_date((F.lit(2025) + k % 2).cast("int"), m, F.lit(14)).alias("ConfStmtNextDueDate"),
        F.make_date(F.lit(2024), m, F.lit(14)).alias("ConfStmtLastMadeUpDate"),
        sic1.alias("SICCode.SicText_1"),
        F.when(k % 2 == 0, F.lit("62090 - Other information technology service activities")).alias("SICCode.SicText_2"),
        F.when(k % 4 == 0, F.lit("62020 - Information technology consultancy activities")).alias("SICCode.SicText_3"),
        F.when(k % 8 == 0, F.lit("99999")).alias("SICCode.SicText_4"),
    )


def postcodes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcode directory rows (some without coordinates, some terminated)."""
    p = tpch(spark, sf_dir, "part")
    k = F.col("p_partkey")
    lat = F.when(k % 101 == 50, F.lit(None).cast("double")).otherwise(
        F.lit(51.5) + (k * 37 % 1000 - 500) / F.lit(500.0) + (F.floor(k / 1000).cast("bigint") % 997) / F.lit(1000000.0))
    lon = F.when(k % 103 == 51, F.lit(None).cast("double")).otherwise(
        F.lit(-0.5) + (k * 91 % 1000 - 500) / F.lit(400.0) + (F.floor(k / 1000).cast("bigint") % 991) / F.lit(1000000.0))
    return p.select(
        synthetic_postcode(k).alias("pcds"),
        lat.alias("lat"),
        lon.alias("long"),
        F.concat(F.lit("E01"), F.lpad((k % 35000).cast("string"), 6, "0")).alias("lsoa21"),
        F.when(k % 17 == 5, F.lit("202001")).alias("doterm"),
    )


def psc_raw_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner records, flat (``data_*`` columns); see ``psc_raw`` for the nested form."""
    o = tpch(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    # Every order is an owner record; one customer in nine owns its records
    # under a number absent from the register, so its company has no owner.
    return o.select(
        F.when(ck % 9 == 0, unregistered_number(ck)).otherwise(padded_number(ck)).alias("company_number"),
        F.concat(F.lit("Person "), k.cast("string")).alias("data_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("corporate-entity-person-with-significant-control"))
        .otherwise(F.lit("individual-person-with-significant-control")).alias("data_kind"),
        F.when(k % 50 == 0, F.lit(None).cast("int")).otherwise((F.lit(1935) + k % 70).cast("int")).alias("data_birth_year"),
        F.when(k % 4 == 0, F.lit("British")).otherwise(F.lit("Irish")).alias("data_nationality"),
        F.when(k % 37 == 0, F.lit(None).cast("date")).otherwise(
            F.make_date((F.lit(2004) + k % 20).cast("int"), F.month("o_orderdate").cast("int"), (F.lit(1) + k % 28).cast("int"))
        ).alias("data_notified_on"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("data_ceased_on"),
        k.alias("_key"),
    )


def psc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner records in the snapshot's nested shape (``company_number``, ``data``)."""
    flat = psc_raw_flat(spark, sf_dir)
    k = F.col("_key")
    natures = F.when(k % 3 == 0, F.array(F.lit("ownership-of-shares-75-to-100-percent"))).otherwise(
        F.array(F.lit("ownership-of-shares-25-to-50-percent"), F.lit("voting-rights-25-to-50-percent")))
    dob = F.when(F.col("data_birth_year").isNull(), F.lit(None)).otherwise(
        F.struct(F.col("data_birth_year").cast("bigint").alias("year"), (F.lit(1) + k % 12).cast("bigint").alias("month")))
    return flat.select(
        "company_number",
        F.struct(
            F.col("data_name").alias("name"),
            F.col("data_kind").alias("kind"),
            dob.alias("date_of_birth"),
            F.col("data_nationality").alias("nationality"),
            natures.alias("natures_of_control"),
            F.col("data_notified_on").alias("notified_on"),
            F.col("data_ceased_on").alias("ceased_on"),
        ).alias("data"),
    )


def officers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officer appointments: one per order line, YYYYMMDD as bigint.  One
    customer in seven is filed under a number absent from the register, so
    its company has no officer."""
    li = tpch(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = tpch(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    pk, sd, ck = F.col("l_partkey"), F.col("l_shipdate"), F.col("o_custkey")
    appointed = F.when(pk % 41 == 0, F.lit(None).cast("bigint")).otherwise(
        ((F.year(sd) + pk % 20) * 10000 + F.month(sd) * 100 + F.dayofmonth(sd)).cast("bigint"))
    number = F.when(ck % 7 == 0, unregistered_number(ck)).otherwise(padded_number(ck))
    return j.select(number.alias("company_number"), appointed.alias("appointment_date"))


# --- search profiles and requests ---------------------------------------

#: Codes that the derived register holds, from which profiles take pairs.
PROFILE_CODES = [62020, 43220, 71121, 62090]


def profile_name(nation: Column) -> Column:
    return F.concat(F.lit("nation_"), F.lpad(nation.cast("string"), 2, "0"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved profile per nation; six kinds of condition follow from the
    nation's key by rule, so that every condition is given by some and left
    out by others."""
    k = F.col("n_nationkey").cast("int")
    kind = k % 6
    code = F.array(*[F.lit(c).cast("bigint") for c in PROFILE_CODES])
    first = F.lit(45) + 5 * kind
    return tpch(spark, sf_dir, "nation").select(
        profile_name(F.col("n_nationkey")).alias("profile"),
        F.element_at(F.array(F.lit("AB24 0AQ"), F.lit("AB30 0AQ"), F.lit("AB11 0AQ")), k % 3 + 1).alias("postcode"),
        (F.lit(25) + 7 * kind).cast("double").alias("radius_miles"),
        F.when(kind == 5, F.lit("Dissolved")).alias("company_status"),
        F.when(kind % 2 == 1, F.array(F.lit("SMALL"), F.lit("FULL"))).alias("account_categories"),
        F.when(kind != 5, F.array(F.element_at(code, kind % 4 + 1), F.element_at(code, (kind + 1) % 4 + 1))).alias("sic_codes"),
        F.when(kind % 2 == 0, kind + 2).alias("min_company_age_years"),
        F.when(kind == 3, F.lit(60)).alias("max_company_age_years"),
        F.when(kind % 3 == 0, first).alias("min_psc_age"),
        F.when(kind % 3 == 0, first + 25).alias("max_psc_age"),
        F.when(kind == 4, F.lit(2)).alias("min_psc_tenure_years"),
        F.when(kind == 2, F.lit(30)).alias("max_psc_tenure_years"),
        F.when(kind == 4, F.lit(True)).alias("strict_psc_tenure"),
        F.when(kind < 4, F.lit("csv")).otherwise(F.lit("xlsx")).alias("output_format"),
        F.when(kind == 1, F.lit(40)).alias("max_results"),
    )


def requests_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier: a profile (by nation) plus explicit
    overrides; NULL means "not given".  Some requests are invalid on purpose."""
    s = tpch(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pc = synthetic_postcode(k)
    profile = F.when(k % 71 == 0, F.lit("nation_unknown")).otherwise(profile_name(F.col("s_nationkey")))
    null_i = F.lit(None).cast("int")
    return s.select(
        F.concat(F.lit("R"), F.lpad(k.cast("string"), 6, "0")).alias("request_id"),
        profile.alias("profile"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.lower(pc))
        .when(k % 3 == 1, F.replace(pc, F.lit(" "), F.lit("")))
        .otherwise(pc).alias("postcode"),
        F.when(k % 10 == 0, F.lit(None).cast("double"))
        .when(k % 97 == 0, F.lit(501.0))
        .when(k % 89 == 0, F.lit(0.0))
        .otherwise((F.lit(1) + k % 20).cast("double")).alias("radius_miles"),
        F.when(k % 31 == 0, F.lit("closed")).when(k % 13 == 0, F.lit("Dissolved")).alias("company_status"),
        F.when(k % 29 == 0, F.array().cast("array<string>"))
        .when(k % 11 == 0, F.array(F.lit("SMALL"))).alias("account_categories"),
        F.when(k % 43 == 0, F.array().cast("array<bigint>"))
        .when(k % 7 == 0, F.array(F.lit(62020)).cast("array<bigint>")).alias("sic_codes"),
        F.when(k % 8 == 0, F.lit(5)).otherwise(null_i).alias("min_company_age_years"),
        F.when(k % 16 == 0, F.lit(40)).otherwise(null_i).alias("max_company_age_years"),
        F.when(k % 61 == 0, F.lit(15)).when(k % 5 == 0, (F.lit(40) + k % 30).cast("int")).alias("min_psc_age"),
        F.when(k % 5 == 0, (F.lit(70) + k % 40).cast("int")).alias("max_psc_age"),
        F.when(k % 6 == 0, (F.lit(1) + k % 10).cast("int")).alias("min_psc_tenure_years"),
        F.when(k % 12 == 0, F.lit(15)).alias("max_psc_tenure_years"),
        F.when((k % 6 == 0) & (k % 4 == 0), F.lit(True)).alias("strict_psc_tenure"),
        F.when(k % 83 == 0, F.lit("pdf")).when(k % 9 == 0, F.lit("xlsx")).alias("output_format"),
        F.when(k % 3 == 0, (F.lit(5) + k % 10).cast("int")).alias("max_results"),
    )


def fixture_tables(spark: SparkSession, sf_dir: str, ingest_as_of="2025-06-30"):
    """The prepared tables computed (lazily) from the derived raw fixtures."""
    from prospect.operators import prepare
    from prospect.sources.tables import Tables

    return Tables(
        companies=prepare.prepare_companies(companies_raw(spark, sf_dir)),
        company_sic=prepare.prepare_company_sic(companies_raw(spark, sf_dir)),
        postcodes=prepare.prepare_postcodes(postcodes_raw(spark, sf_dir)),
        psc=prepare.prepare_psc(psc_raw(spark, sf_dir), ingest_as_of),
        officers=prepare.prepare_officers(officers_raw(spark, sf_dir)),
    )
