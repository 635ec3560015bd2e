"""Row predicates on companies (R1-R4).  All are plain ``where`` clauses;
equality and IN lists on raw columns reach the Parquet scan."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.functions.expressions import as_of_date, year_diff

DORMANT = "DORMANT"


def status_condition(status: str | Column) -> Column:
    return F.col("CompanyStatus") == (status if isinstance(status, Column) else F.lit(status))


def filter_status(df: DataFrame, status: str = "Active") -> DataFrame:
    """Exact, case-sensitive status match (default 'Active')."""
    return df.where(status_condition(status))


def filter_account_category(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """R2: account category in the requested list."""
    return df.where(F.col("AccountCategory").isin(list(categories)))


def non_dormant_condition() -> Column:
    return (F.col("AccountCategory") != F.lit(DORMANT)) | F.col("AccountCategory").isNull()


def filter_default_non_dormant(df: DataFrame) -> DataFrame:
    """Without a category list, drop DORMANT but keep unknown (NULL)."""
    return df.where(non_dormant_condition())


def account_category_condition(categories: Sequence[str] | None) -> Column:
    """R2 when a non-empty list is given, else R3 (an empty list counts as none)."""
    if categories:
        return F.col("AccountCategory").isin(list(categories))
    return non_dormant_condition()


def company_age_condition(as_of: _dt.date | str | None, min_years: int | None, max_years: int | None) -> Column | None:
    age = year_diff(as_of_date(as_of), "IncorporationDate")
    cond = None
    if min_years is not None:
        cond = age >= F.lit(int(min_years))
    if max_years is not None:
        upper = age <= F.lit(int(max_years))
        cond = upper if cond is None else cond & upper
    return cond


def filter_company_age(df: DataFrame, as_of: _dt.date | str | None, min_years: int | None = None,
                       max_years: int | None = None) -> DataFrame:
    """Company age in calendar years within the bounds; an unknown
    incorporation date fails any bound."""
    cond = company_age_condition(as_of, min_years, max_years)
    return df if cond is None else df.where(cond)
