"""Data-quality reports of the prepare stage (Q1-Q8).

Each report is one aggregation pass (``count_if`` for every counter at
once) returning a one-row DataFrame, instead of one scan per number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospect.functions.expressions import split_sic_text
from prospect.operators.prepare import INDIVIDUAL_KIND, keeps_psc, sic_texts
from prospect.sources import schemas

UK_LAT = (49, 61)
UK_LONG = (-8, 2)


def company_counts(companies: DataFrame) -> DataFrame:
    """Q1: total and active companies."""
    return companies.agg(
        F.count(F.lit(1)).alias("total_companies"),
        F.count_if(F.col("CompanyStatus") == "Active").alias("active_companies"),
    )


def missing_postcodes(companies: DataFrame) -> DataFrame:
    """Q2: active companies without a registered postcode."""
    return companies.agg(
        F.count_if((F.col("CompanyStatus") == "Active") & F.col("RegAddressPostCode").isNull())
        .alias("active_without_postcode"))


def sic_stats(company_sic: DataFrame) -> DataFrame:
    """Q3: mappings, distinct codes, distinct companies."""
    return company_sic.agg(
        F.count(F.lit(1)).alias("mappings"),
        F.count_distinct("sic_code").alias("unique_codes"),
        F.count_distinct("CompanyNumber").alias("companies_with_sic"),
    )


def sic_parse_failures(raw_companies: DataFrame) -> DataFrame:
    """Q4: filled industry-code fields, parsed codes, failures and their
    percentage, from one scan of the raw register."""
    code, _ = split_sic_text(F.col("sic_text"))
    counts = sic_texts(raw_companies).agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(code.isNotNull()).alias("parsed_codes"),
    )
    failed = F.col("total_fields") - F.col("parsed_codes")
    return counts.select(
        "total_fields", "parsed_codes", failed.alias("failed_codes"),
        (F.try_divide(failed, F.col("total_fields")) * 100).alias("failed_pct"),
    )


def sic_failed_samples(raw_companies: DataFrame, n: int = 5) -> DataFrame:
    """Q5: up to ``n`` unparsable position-1 texts (ordered by company)."""
    text = F.col("`SICCode.SicText_1`")
    code, _ = split_sic_text(text)
    return (
        raw_companies.where(text.isNotNull() & code.isNull())
        .select(F.col("`CompanyNumber`").alias("CompanyNumber"), text.alias("sic_text"))
        .orderBy("CompanyNumber")
        .limit(n)
    )


def _bounds(df: DataFrame, count_name: str | None) -> DataFrame:
    aggs = [F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
            F.min("long").alias("min_long"), F.max("long").alias("max_long")]
    if count_name:
        aggs.insert(0, F.count(F.lit(1)).alias(count_name))
    out = df.agg(*aggs)
    return out.select(
        "*",
        ((F.col("min_lat") >= UK_LAT[0]) & (F.col("max_lat") <= UK_LAT[1])).alias("lat_within_uk"),
        ((F.col("min_long") >= UK_LONG[0]) & (F.col("max_long") <= UK_LONG[1])).alias("long_within_uk"),
    )


def postcode_bounds(postcodes: DataFrame) -> DataFrame:
    """Q6: postcode count, coordinate ranges and UK-bounds flags."""
    return _bounds(postcodes, "postcodes")


def psc_stats(psc: DataFrame) -> DataFrame:
    """Q7: owners, companies with owners, min / avg / max age."""
    return psc.agg(
        F.count(F.lit(1)).alias("psc_count"),
        F.count_distinct("company_number").alias("companies_with_psc"),
        F.min("approximate_age").alias("min_age"),
        F.avg("approximate_age").alias("avg_age"),
        F.max("approximate_age").alias("max_age"),
    )


def psc_drop_accounting(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Q8: raw lines versus kept owner records, with the reason each dropped
    line was dropped (blank, malformed JSON, not an individual, ceased, no birth
    year; first applicable reason).  One pass over the text lines: each
    line is parsed with ``from_json`` in the same scan that counts it."""
    lines = spark.read.text(path)
    parsed = F.from_json(F.col("value"), schemas.PSC_JSON_WITH_CORRUPT,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT_COLUMN,
                          "dateFormat": "yyyy-MM-dd"})
    r = lines.select(F.col("value"), parsed.alias("r"))
    blank = F.trim(F.col("value")) == ""
    # Kept by the prepare stage's own rule; a line is malformed if it is not
    # kept and did not parse.
    kept = ~blank & keeps_psc(F.col("r.data"))
    malformed = ~blank & ~kept & F.col(f"r.{schemas.CORRUPT_COLUMN}").isNotNull()
    ok = ~blank & ~malformed & ~kept
    kind = F.col("r.data.kind")
    individual = kind == F.lit(INDIVIDUAL_KIND)
    ceased = F.col("r.data.ceased_on").isNotNull()
    born = F.col("r.data.date_of_birth.year").isNotNull()
    counts = r.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(kept).alias("parsed_records"),
        F.count_if(blank).alias("blank"),
        F.count_if(malformed).alias("malformed"),
        F.count_if(ok & ~F.coalesce(individual, F.lit(False))).alias("non_individual"),
        F.count_if(ok & individual & ceased).alias("ceased"),
        F.count_if(ok & individual & ~ceased & ~born).alias("missing_birth_year"),
    )
    dropped = F.col("total_lines") - F.col("parsed_records")
    return counts.select(
        "total_lines", "parsed_records", dropped.alias("dropped"),
        (F.try_divide(dropped, F.col("total_lines")) * 100).alias("dropped_pct"),
        "blank", "malformed", "non_individual", "ceased", "missing_birth_year",
    )
