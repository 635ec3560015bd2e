"""One-to-many filters as semi / anti joins.

The reference writes ``INNER JOIN ... SELECT DISTINCT`` and correlated
``[NOT] EXISTS``; here each becomes a ``left_semi`` / ``left_anti`` join
against the *distinct* company numbers that qualify.  The distinct runs as
a partial aggregate in every map task first, so a company with a huge
number of owners is reduced to one row per task before anything shuffles.

Bounds equal to the defaults are dropped exactly as the reference does
(owner age 16 / 120, owner tenure 1 / 100), but the join itself always
applies: asking for ``min_psc_age=16`` still removes companies without
owners.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.operators.aggregates import officer_tenure, psc_tenure

# The reference's "no bound" defaults.
DEFAULT_MIN_PSC_AGE, DEFAULT_MAX_PSC_AGE = 16, 120
DEFAULT_MIN_TENURE, DEFAULT_MAX_TENURE = 1, 100


def _qualifying(detail: DataFrame, key: str, cond: Column | None) -> DataFrame:
    rows = detail if cond is None else detail.where(cond)
    return rows.select(F.col(key).alias("CompanyNumber")).distinct()


def _semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, "CompanyNumber", "left_semi")


def _anti(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, "CompanyNumber", "left_anti")


def psc_age_condition(min_age: int | None, max_age: int | None) -> Column | None:
    """Owner-age test with default bounds dropped (None = "1=1")."""
    lo = min_age or DEFAULT_MIN_PSC_AGE
    hi = max_age or DEFAULT_MAX_PSC_AGE
    cond = None
    if lo > DEFAULT_MIN_PSC_AGE:
        cond = F.col("approximate_age") >= F.lit(lo)
    if hi < DEFAULT_MAX_PSC_AGE:
        c = F.col("approximate_age") <= F.lit(hi)
        cond = c if cond is None else cond & c
    return cond


def psc_tenure_condition(as_of, min_tenure: int | None, max_tenure: int | None) -> Column | None:
    """Owner-tenure test with default bounds dropped (None = "1=1")."""
    lo = min_tenure or DEFAULT_MIN_TENURE
    hi = max_tenure or DEFAULT_MAX_TENURE
    t = psc_tenure(as_of)
    cond = None
    if lo > DEFAULT_MIN_TENURE:
        cond = t >= F.lit(lo)
    if hi < DEFAULT_MAX_TENURE:
        c = t <= F.lit(hi)
        cond = c if cond is None else cond & c
    return cond


def officer_tenure_condition(as_of, min_tenure: int | None, max_tenure: int | None) -> Column:
    """Officer tenure ``BETWEEN min AND max`` (defaults 1 / 100 always apply)."""
    lo = min_tenure or DEFAULT_MIN_TENURE
    hi = max_tenure or DEFAULT_MAX_TENURE
    return officer_tenure(as_of).between(F.lit(lo), F.lit(hi))


def filter_sic_any(df: DataFrame, company_sic: DataFrame, codes: Sequence[int]) -> DataFrame:
    """Companies with at least one listed industry code (any position)."""
    cond = F.col("sic_code").isin([int(c) for c in codes])
    return _semi(df, _qualifying(company_sic, "CompanyNumber", cond))


def filter_psc_age_any(df: DataFrame, psc: DataFrame, min_age: int | None = None, max_age: int | None = None) -> DataFrame:
    """At least one owner whose age meets both bounds."""
    return _semi(df, _qualifying(psc, "company_number", psc_age_condition(min_age, max_age)))


def filter_has_dated_officer(df: DataFrame, officers: DataFrame) -> DataFrame:
    """At least one officer with a known appointment date."""
    return _semi(df, _qualifying(officers, "company_number", F.col("appointment_date").isNotNull()))


def filter_officer_tenure_any(df: DataFrame, officers: DataFrame, as_of: _dt.date | str | None,
                              min_tenure: int | None = None, max_tenure: int | None = None) -> DataFrame:
    """At least one dated officer whose tenure is BETWEEN the bounds."""
    cond = F.col("appointment_date").isNotNull() & officer_tenure_condition(as_of, min_tenure, max_tenure)
    return _semi(df, _qualifying(officers, "company_number", cond))


def filter_psc_tenure_any(df: DataFrame, psc: DataFrame, officers: DataFrame, as_of: _dt.date | str | None,
                          min_tenure: int | None = None, max_tenure: int | None = None) -> DataFrame:
    """Some owner within the tenure bounds and (independently) some dated
    officer whose tenure is BETWEEN them."""
    owners = _qualifying(psc, "company_number", psc_tenure_condition(as_of, min_tenure, max_tenure))
    return filter_officer_tenure_any(_semi(df, owners), officers, as_of, min_tenure, max_tenure)


def filter_psc_tenure_strict(df: DataFrame, psc: DataFrame, officers: DataFrame, as_of: _dt.date | str | None,
                             min_tenure: int | None = None, max_tenure: int | None = None) -> DataFrame:
    """No owner violates the tenure bounds (vacuously true without owners;
    an unknown date never violates) and some officer has a known date."""
    cond = psc_tenure_condition(as_of, min_tenure, max_tenure)
    out = df
    if cond is not None:
        out = _anti(out, _qualifying(psc, "company_number", ~cond))
    return filter_has_dated_officer(out, officers)
