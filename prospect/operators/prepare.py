"""Prepare stage (P1-P6): raw snapshots -> the prepared tables.

Each function is a narrow, map-only transformation except
``prepare_postcodes``, whose de-duplication on the normalised postcode is
one hash aggregate (partial aggregation before the shuffle).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.functions.expressions import as_of_date, normalise_postcode, split_sic_text
from prospect.sources.schemas import SIC_TEXT_COLUMNS

INDIVIDUAL_KIND = "individual-person-with-significant-control"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def prepare_companies(raw: DataFrame) -> DataFrame:
    """Project and rename the register's dotted fields; drop rows without
    a company number."""
    return raw.select(
        _c("CompanyNumber").alias("CompanyNumber"),
        _c("CompanyName").alias("CompanyName"),
        _c("RegAddress.PostCode").alias("RegAddressPostCode"),
        _c("CompanyStatus").alias("CompanyStatus"),
        _c("CompanyCategory").alias("CompanyCategory"),
        _c("CountryOfOrigin").alias("CountryOfOrigin"),
        _c("IncorporationDate").alias("IncorporationDate"),
        _c("Accounts.AccountCategory").alias("AccountCategory"),
        _c("Accounts.NextDueDate").alias("AccountsNextDueDate"),
        _c("Accounts.LastMadeUpDate").alias("AccountsLastMadeUpDate"),
        _c("ConfStmtNextDueDate").alias("ConfStmtNextDueDate"),
        _c("ConfStmtLastMadeUpDate").alias("ConfStmtLastMadeUpDate"),
    ).where(F.col("CompanyNumber").isNotNull())


def sic_texts(raw: DataFrame) -> DataFrame:
    """Unpivot SicText_1..4 into (CompanyNumber, sic_text, sic_position),
    blanks dropped.  One scan and one ``posexplode``, not four scans."""
    texts = F.array(*[_c(c) for c in SIC_TEXT_COLUMNS])
    return (
        raw.select(_c("CompanyNumber").alias("CompanyNumber"), F.posexplode(texts).alias("pos", "sic_text"))
        .where(F.col("sic_text").isNotNull())
        .select("CompanyNumber", "sic_text", (F.col("pos") + 1).cast("int").alias("sic_position"))
    )


def parse_sic_text(texts: DataFrame) -> DataFrame:
    """Split ``"code - description"``; ``try_cast`` the code (NULL when it
    does not parse)."""
    code, description = split_sic_text(F.col("sic_text"))
    return texts.select(
        "CompanyNumber", "sic_text",
        code.alias("sic_code"), description.alias("sic_description"), "sic_position",
    )


def prepare_company_sic(raw: DataFrame) -> DataFrame:
    """One row per company and parsed industry code, with its position."""
    return (
        parse_sic_text(sic_texts(raw))
        .where(F.col("sic_code").isNotNull())
        .select("CompanyNumber", "sic_code", "sic_description", "sic_position")
    )


def prepare_postcodes(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """Live, geocoded postcodes (lat and long known, not terminated).

    With ``dedupe`` the normalised postcode is made unique (smallest ``pcds``
    wins), so the geocoding join can never fan a company out.  Partial
    aggregation keeps this one cheap shuffle even for a hot key.
    """
    live = raw.where(F.col("lat").isNotNull() & F.col("long").isNotNull() & F.col("doterm").isNull()).select(
        "pcds", "lat", "long", "lsoa21")
    if not dedupe:
        return live
    best = F.min(F.struct("pcds", "lat", "long", "lsoa21")).alias("best")
    return (
        live.groupBy(normalise_postcode("pcds").alias("_pc"))
        .agg(best)
        .select("best.pcds", "best.lat", "best.long", "best.lsoa21")
    )


def psc_approximate_age(birth_year: Column, ingest_as_of: _dt.date | str | None = None) -> Column:
    """``year(as_of) - birth_year`` (calendar years, frozen at prepare time)."""
    return (F.year(as_of_date(ingest_as_of)) - birth_year).cast("int")


def keeps_psc(d: Column) -> Column:
    """Whether an owner's ``data`` is kept: an individual, not ceased (any
    value counts as ceased), with a birth year."""
    return F.coalesce((d["kind"] == INDIVIDUAL_KIND) & d["ceased_on"].isNull() & d["date_of_birth"]["year"].isNotNull(), F.lit(False))


def prepare_psc(raw: DataFrame, ingest_as_of: _dt.date | str | None = None) -> DataFrame:
    """P5: flatten owner records; keep active individuals with a birth year."""
    d = F.col("data")
    birth_year = d["date_of_birth"]["year"].cast("int")
    return raw.where(keeps_psc(d)).select(
        F.col("company_number"),
        d["name"].alias("name"),
        d["kind"].alias("kind"),
        birth_year.alias("birth_year"),
        psc_approximate_age(birth_year, ingest_as_of).alias("approximate_age"),
        d["nationality"].alias("nationality"),
        d["natures_of_control"].alias("natures_of_control"),
        d["notified_on"].alias("notified_on"),
    )


def prepare_officers(raw: DataFrame) -> DataFrame:
    """Officer appointments as the search reads them."""
    return raw.select(F.col("company_number").cast("string"), F.col("appointment_date").cast("bigint"))
