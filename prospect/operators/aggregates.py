"""Per-company aggregates (A1-A5) and the per-company profile.

Each aggregate is one ``groupBy`` on the company number: a partial
aggregation before the shuffle and a final one after, so a company holding a
third of all rows is folded inside every map task and never lands whole in
one reducer.  A1-A3 are the reference's three aggregates as such; the
search and the batch use the profile (below), which holds the same
information for all three in one row per company, and derive A5's columns
and the one-to-many filters from it.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.functions.expressions import as_of_date, year_diff, yyyymmdd_year

SIC_COLUMNS = ["sic_count", "primary_sic_code", "primary_sic_description"]
PSC_COLUMNS = ["psc_count", "youngest_psc_age", "oldest_psc_age", "psc_last_updated",
               "min_psc_tenure_years", "max_psc_tenure_years", "avg_psc_tenure_years"]
OFFICER_COLUMNS = ["officer_count", "earliest_officer_appointment", "latest_officer_appointment",
                   "min_officer_tenure_years", "max_officer_tenure_years", "avg_officer_tenure_years"]
COUNT_COLUMNS = ["sic_count", "psc_count", "officer_count"]


def psc_tenure(as_of: _dt.date | str | None) -> Column:
    """Owner tenure: calendar years since ``notified_on`` (NULL when unknown)."""
    return year_diff(as_of_date(as_of), "notified_on")


def officer_tenure(as_of: _dt.date | str | None) -> Column:
    """Officer tenure: year(as_of) minus the year digits of the YYYYMMDD value."""
    return (F.year(as_of_date(as_of)) - yyyymmdd_year("appointment_date")).cast("bigint")


def sic_aggregates(company_sic: DataFrame, match_codes: Sequence[int] | None = None,
                   extra: list[Column] | None = None) -> DataFrame:
    """A1: distinct code count and the position-1 code / description.

    With ``match_codes`` also ``sic_matches``: rows whose code is listed.
    The distinct count is the size of the company's code set (bounded by
    the code list, a few per company): one hash aggregate and one shuffle,
    where ``count(DISTINCT)`` would plan two.
    """
    pos1 = F.col("sic_position") == 1
    aggs = [
        F.size(F.collect_set("sic_code")).cast("bigint").alias("sic_count"),
        F.max(F.when(pos1, F.col("sic_code"))).alias("primary_sic_code"),
        F.max(F.when(pos1, F.col("sic_description"))).alias("primary_sic_description"),
    ]
    if match_codes:
        aggs.append(F.count_if(F.col("sic_code").isin([int(c) for c in match_codes])).alias("sic_matches"))
    aggs += extra or []
    return company_sic.groupBy("CompanyNumber").agg(*aggs)


def psc_aggregates(psc: DataFrame, as_of: _dt.date | str | None = None,
                   age_condition: Column | None = None, tenure_condition: Column | None = None,
                   extra: list[Column] | None = None) -> DataFrame:
    """A2: owner count, youngest / oldest age, last notification and tenure
    min / max / avg (NULL dates ignored by the tenure aggregates).

    Optional counters: ``psc_age_matches`` (owners meeting ``age_condition``),
    ``psc_tenure_matches`` and ``psc_tenure_violations`` (owners for which
    ``tenure_condition`` is true / false; unknown counts as neither).
    """
    tenure = psc_tenure(as_of)
    aggs = [
        F.count(F.lit(1)).alias("psc_count"),
        F.min("approximate_age").alias("youngest_psc_age"),
        F.max("approximate_age").alias("oldest_psc_age"),
        F.max("notified_on").alias("psc_last_updated"),
        F.min(tenure).alias("min_psc_tenure_years"),
        F.max(tenure).alias("max_psc_tenure_years"),
        F.avg(tenure).alias("avg_psc_tenure_years"),
    ]
    if age_condition is not None:
        aggs.append(F.count_if(age_condition).alias("psc_age_matches"))
    if tenure_condition is not None:
        aggs.append(F.count_if(tenure_condition).alias("psc_tenure_matches"))
        aggs.append(F.count_if(~tenure_condition).alias("psc_tenure_violations"))
    aggs += extra or []
    return psc.groupBy("company_number").agg(*aggs)


def officer_aggregates(officers: DataFrame, as_of: _dt.date | str | None = None,
                       tenure_condition: Column | None = None, extra: list[Column] | None = None) -> DataFrame:
    """A3: officers with a known appointment date: count, first / last
    appointment (raw YYYYMMDD) and tenure min / max / avg.

    Optional counter ``officer_tenure_matches`` for ``tenure_condition``.
    """
    tenure = officer_tenure(as_of)
    aggs = [
        F.count(F.lit(1)).alias("officer_count"),
        F.min("appointment_date").alias("earliest_officer_appointment"),
        F.max("appointment_date").alias("latest_officer_appointment"),
        F.min(tenure).alias("min_officer_tenure_years"),
        F.max(tenure).alias("max_officer_tenure_years"),
        F.avg(tenure).alias("avg_officer_tenure_years"),
    ]
    if tenure_condition is not None:
        aggs.append(F.count_if(tenure_condition).alias("officer_tenure_matches"))
    aggs += extra or []
    return officers.where(F.col("appointment_date").isNotNull()).groupBy("company_number").agg(*aggs)


# --- bit sets ------------------------------------------------------------------
#
# A set of small integers as a few 64-bit words, one bit for each value: a
# fixed-width buffer that ``bit_or`` merges in place, so the aggregation hashes
# and combines map-side however many values a company has.  Values outside the
# range go to its first or last bit, which no bound inside the range tells
# apart from what lies beyond.

#: (first value, words): ages 0-127 (requests bound them by 16-120), calendar years
#: 1900-2155 (tenures of 1-100 years before an as-of year from 2001 on).
AGE_BITS, YEAR_BITS = (0, 2), (1900, 4)


def bit_set(value: Column, bits: tuple[int, int], name: str) -> list[Column]:
    """Aggregates ``name_0`` ... ``name_k``: the words of the set of ``value``
    (0 without values)."""
    first, words = bits
    at = F.least(F.greatest(value.cast("int") - F.lit(first), F.lit(0)), F.lit(64 * words - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)))
    # ``greatest`` skips NULL, so a missing value is left out here.
    return [F.coalesce(F.bit_or(F.when(value.isNotNull() & (F.floor(at / 64) == w), bit)), F.lit(0).cast("bigint")).alias(f"{name}_{w}") for w in range(words)]


def bit_columns(bits: tuple[int, int], name: str) -> list[str]:
    return [f"{name}_{w}" for w in range(bits[1])]


def bit_mask(bits: tuple[int, int], lo: Column, hi: Column) -> list[Column]:
    """The words of the values from ``lo`` to ``hi`` (NULL: no bound)."""
    first, words = bits
    zero, ones = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    masks = []
    for w in range(words):
        origin = F.lit(first + 64 * w)
        a = F.greatest(F.coalesce(lo.cast("bigint") - origin, zero), zero)
        z = F.least(F.coalesce(hi.cast("bigint") - origin, F.lit(63).cast("bigint")), F.lit(63).cast("bigint"))
        mask = F.call_function("shiftleft", ones, a.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", ones, (F.lit(63) - z).cast("int")))
        masks.append(F.when(a <= z, mask).otherwise(zero))
    return masks


def bits_meet(bits: tuple[int, int], name: str, mask: list[Column]) -> Column:
    """Whether the set holds a value of ``mask``; false for a missing set."""
    zero = F.lit(0).cast("bigint")
    met = zero
    for w in range(bits[1]):
        met = met.bitwiseOR(F.coalesce(F.col(f"{name}_{w}"), zero).bitwiseAND(mask[w]))
    return met != 0


def bits_between(bits: tuple[int, int], name: str, lo: Column, hi: Column) -> Column:
    """Whether the set holds a value from ``lo`` to ``hi`` (NULL: no bound);
    false for a missing set."""
    return bits_meet(bits, name, bit_mask(bits, lo, hi))


def bit_values(bits: tuple[int, int], name: str) -> Column:
    """The set's values in order, as an array."""
    first, words = bits
    def held(w: int):
        return lambda b: F.call_function("shiftright", F.col(f"{name}_{w}"), b).bitwiseAND(F.lit(1).cast("bigint")) == 1

    def shown(w: int):
        return lambda b: b + F.lit(first + 64 * w)

    places = F.sequence(F.lit(0), F.lit(63))
    return F.concat(*(F.transform(F.filter(places, held(w)), shown(w)) for w in range(words)))


# --- per-company profile ------------------------------------------------------
#
# One row per company holding everything A1-A3 and the one-to-many filters
# need, independent of the request and of the as-of date: counts, extremes,
# exact integer sums of the notification / appointment *years*, the set of
# industry codes and bit sets of owner ages and years.  Tenures are derived at
# query time as as-of year minus year; averages from the integer sums, so every
# derived column equals the reference's aggregate bit for bit.

PROFILE_KEY = "CompanyNumber"


def _people(psc: DataFrame, officers: DataFrame) -> DataFrame:
    """Owners and dated officers stacked on one schema (NULL where a column
    does not apply), so one aggregation and one shuffle fold both."""
    none = {t: F.lit(None).cast(t) for t in ("int", "date", "bigint")}
    owners = psc.select(
        F.col("company_number").alias(PROFILE_KEY), F.lit(True).alias("_owner"),
        F.col("approximate_age").cast("int").alias("approximate_age"), F.col("notified_on"), none["bigint"].alias("appointment_date"))
    dated = officers.where(F.col("appointment_date").isNotNull()).select(
        F.col("company_number").alias(PROFILE_KEY), F.lit(False).alias("_owner"), none["int"].alias("approximate_age"),
        none["date"].alias("notified_on"), F.col("appointment_date").cast("bigint").alias("appointment_date"))
    return owners.unionByName(dated)


def people_profiles(psc: DataFrame, officers: DataFrame) -> DataFrame:
    """Per company, what its owners and officers give to the profile: numbers of
    fixed width only, so partial and final aggregation both hash in place."""
    py = F.year("notified_on")
    oy = yyyymmdd_year("appointment_date")
    return _people(psc, officers).groupBy(PROFILE_KEY).agg(
        F.count_if(F.col("_owner")).alias("psc_count"),
        F.min("approximate_age").alias("youngest_psc_age"),
        F.max("approximate_age").alias("oldest_psc_age"),
        F.max("notified_on").alias("psc_last_updated"),
        F.min(py).alias("psc_year_min"), F.max(py).alias("psc_year_max"),
        F.sum(py).alias("psc_year_sum"), F.count(py).alias("psc_year_n"),
        *bit_set(F.col("approximate_age"), AGE_BITS, "psc_ages"), *bit_set(py, YEAR_BITS, "psc_years"),
        F.count_if(~F.col("_owner")).alias("officer_count"),
        F.min("appointment_date").alias("earliest_officer_appointment"),
        F.max("appointment_date").alias("latest_officer_appointment"),
        F.min(oy).alias("officer_year_min"), F.max(oy).alias("officer_year_max"),
        F.sum(oy).alias("officer_year_sum"), F.count(oy).alias("officer_year_n"),
        *bit_set(oy, YEAR_BITS, "officer_years"))


def code_profiles(company_sic: DataFrame) -> DataFrame:
    """Per company, its set of industry codes (a few: one register row holds at
    most four) and the position-1 code and description."""
    pos1 = F.col("sic_position") == 1
    return company_sic.groupBy(F.col("CompanyNumber").alias(PROFILE_KEY)).agg(
        F.collect_set(F.col("sic_code").cast("int")).alias("sic_code_set"),
        F.max(F.when(pos1, F.col("sic_code").cast("int"))).alias("primary_sic_code"),
        F.max(F.when(pos1, F.col("sic_description"))).alias("primary_sic_description"))


def company_profiles(company_sic: DataFrame, psc: DataFrame, officers: DataFrame) -> DataFrame:
    """Per-company profile (see above): two aggregations partitioned alike, so
    their join adds no shuffle; each folds hot companies map-side."""
    joined = people_profiles(psc, officers).join(code_profiles(company_sic), PROFILE_KEY, "full_outer")
    zero = F.lit(0).cast("bigint")
    counts = ["psc_count", "psc_year_n", "officer_count", "officer_year_n"]
    sets = [*bit_columns(AGE_BITS, "psc_ages"), *bit_columns(YEAR_BITS, "psc_years"), *bit_columns(YEAR_BITS, "officer_years")]
    return joined.withColumns({
        "sic_code_set": F.coalesce("sic_code_set", F.array().cast("array<int>")),
        **{c: F.coalesce(c, zero) for c in [*counts, *sets]}})


def _tenure_avg(y: Column, total: str, n: str) -> Column:
    """avg(Y - year) from the exact integer sum: (n*Y - sum) / n."""
    return F.when(F.col(n) > 0, (F.col(n) * y - F.col(total)).cast("double") / F.col(n))


def profile_enrichment(as_of: _dt.date | str | None = None) -> dict[str, Column]:
    """The reference's 16 enrichment columns from a (left-joined) profile row."""
    y = F.year(as_of_date(as_of)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return {
        "sic_count": F.when(F.col("sic_code_set").isNull(), zero).otherwise(F.size(F.col("sic_code_set")).cast("bigint")),
        "primary_sic_code": F.col("primary_sic_code"),
        "primary_sic_description": F.col("primary_sic_description"),
        "psc_count": F.coalesce(F.col("psc_count"), zero),
        "youngest_psc_age": F.col("youngest_psc_age"),
        "oldest_psc_age": F.col("oldest_psc_age"),
        "psc_last_updated": F.col("psc_last_updated"),
        "min_psc_tenure_years": y - F.col("psc_year_max"),
        "max_psc_tenure_years": y - F.col("psc_year_min"),
        "avg_psc_tenure_years": _tenure_avg(y, "psc_year_sum", "psc_year_n"),
        "officer_count": F.coalesce(F.col("officer_count"), zero),
        "earliest_officer_appointment": F.col("earliest_officer_appointment"),
        "latest_officer_appointment": F.col("latest_officer_appointment"),
        "min_officer_tenure_years": y - F.col("officer_year_max"),
        "max_officer_tenure_years": y - F.col("officer_year_min"),
        "avg_officer_tenure_years": _tenure_avg(y, "officer_year_sum", "officer_year_n"),
    }


PROFILE_ONLY_COLUMNS = ["sic_code_set", "psc_year_min", "psc_year_max", "psc_year_sum", "psc_year_n", "officer_year_min",
                        "officer_year_max", "officer_year_sum", "officer_year_n", *bit_columns(AGE_BITS, "psc_ages"),
                        *bit_columns(YEAR_BITS, "psc_years"), *bit_columns(YEAR_BITS, "officer_years")]


#: What ``profile_passes`` reads of a profile row, besides a batch's ``code_bits``.
TESTED_COLUMNS = ["sic_code_set", "psc_count", "officer_count", "psc_year_min", "psc_year_max", *bit_columns(AGE_BITS, "psc_ages"),
                  *bit_columns(YEAR_BITS, "psc_years"), *bit_columns(YEAR_BITS, "officer_years")]
#: The masks among ``profile_tests``.
MASKS = [*bit_columns(AGE_BITS, "ages"), *bit_columns(YEAR_BITS, "owner_years"), *bit_columns(YEAR_BITS, "officer_years")]

#: Profile columns that are 0 where a company has no detail row.
PROFILE_COUNTS = ["psc_count", "officer_count", *bit_columns(AGE_BITS, "psc_ages"), *bit_columns(YEAR_BITS, "psc_years"),
                  *bit_columns(YEAR_BITS, "officer_years")]


def _lower(v: Column, default: int) -> Column:
    """A bound equal to the reference's default means "no bound" (NULL)."""
    c = F.coalesce(v, F.lit(default))
    return F.when(c > default, c)


def _upper(v: Column, default: int) -> Column:
    c = F.coalesce(v, F.lit(default))
    return F.when(c < default, c)


def profile_conditions(as_of, sic_codes: Column, min_age: Column, max_age: Column, min_tenure: Column,
                       max_tenure: Column, strict: Column) -> Column:
    """J1-J4 semantics on a profile row, with the request's parameters as
    Columns (literals for one request, columns for a batch):

    * industry: any listed code (no list or an empty one = no condition);
    * owner age: some owner meets both bounds (defaults 16 / 120 dropped, but
      asking at all requires an owner);
    * tenure, any mode: some owner within the bounds (NULL dates never
      match a bound) and, independently, some dated officer whose tenure is
      BETWEEN min and max (defaults 1 / 100 always apply);
    * tenure, strict mode: no owner violates the bounds (vacuously true
      without owners; NULL dates never violate) and some dated officer.
    """
    return profile_passes(profile_tests(as_of, sic_codes, min_age, max_age, min_tenure, max_tenure, strict))


#: Listed codes that are looked up one by one; more are compared as sets.
FEW_CODES = 4


def profile_tests(as_of, sic_codes: Column, min_age: Column, max_age: Column, min_tenure: Column,
                  max_tenure: Column, strict: Column) -> dict[str, Column]:
    """The request's side of ``profile_conditions`` as values by name, so that a batch
    works them out once a request and a pair only compares: listed codes (NULL: no
    condition), masks of ages and years, the years that violate."""
    y = F.year(as_of_date(as_of)).cast("bigint")
    t_lo, t_hi = _lower(min_tenure, 1), _upper(max_tenure, 100)
    o_lo, o_hi = F.coalesce(min_tenure, F.lit(1)), F.coalesce(max_tenure, F.lit(100))
    def words(name: str, bits: tuple[int, int], lo: Column, hi: Column) -> dict[str, Column]:
        return dict(zip(bit_columns(bits, name), bit_mask(bits, lo, hi)))

    bound = min_tenure.isNotNull() | max_tenure.isNotNull()
    return {
        "codes": F.when(F.size(sic_codes) > 0, sic_codes.cast("array<bigint>")),
        "aged": min_age.isNotNull() | max_age.isNotNull(),
        **words("ages", AGE_BITS, _lower(min_age, 16), _upper(max_age, 120)),
        "any_tenure": bound & ~F.coalesce(strict, F.lit(False)), "strict": bound & F.coalesce(strict, F.lit(False)),
        "unbound": t_lo.isNull() & t_hi.isNull(),
        **words("owner_years", YEAR_BITS, y - t_hi, y - t_lo),
        **words("officer_years", YEAR_BITS, y - o_hi, y - o_lo),
        "newest": y - t_lo, "oldest": y - t_hi}


def code_bits(codes: Column) -> Column:
    """A word with a bit by the hash of each code: two lists without a common bit have
    no common code."""
    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.aggregate(codes.cast("array<bigint>"), zero, lambda bits, code: bits.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(code), F.lit(64))))), zero)


def held_code_tests(codes: Column) -> dict[str, Column]:
    """More of a batch's ``profile_tests``: whether the codes are few, and their bits."""
    return {"few": F.coalesce(F.size(codes) <= FEW_CODES, F.lit(True)), "code_bits": code_bits(codes)}


def codes_meet(codes: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.col("sic_code_set").cast("array<bigint>"), codes), F.lit(False))


def held_codes_meet(tests: dict[str, Column], bits: Column) -> Column:
    """``codes_meet`` for rows that hold a profile's ``code_bits`` and requests that hold
    ``held_code_tests``: most pairs without a common code differ in all bits, and few
    codes need no set."""
    one_by_one = F.lit(False)
    for i in range(FEW_CODES):
        one_by_one = one_by_one | F.coalesce(F.array_contains(F.col("sic_code_set").cast("array<bigint>"), F.get(tests["codes"], F.lit(i))), F.lit(False))
    return (bits.bitwiseAND(tests["code_bits"]) != 0) & F.when(tests["few"], one_by_one).otherwise(codes_meet(tests["codes"]))


def profile_passes(tests: dict[str, Column], codes_common: Column | None = None) -> Column:
    """``profile_conditions`` of a profile row and a request's ``profile_tests``."""
    def words(name: str, bits: tuple[int, int]) -> list[Column]:
        return [tests[c] for c in bit_columns(bits, name)]

    sic_ok = tests["codes"].isNull() | (codes_meet(tests["codes"]) if codes_common is None else codes_common)
    owned = F.coalesce(F.col("psc_count"), F.lit(0)) > 0
    age_ok = ~tests["aged"] | (owned & bits_meet(AGE_BITS, "psc_ages", words("ages", AGE_BITS)))
    owner_any = owned & (tests["unbound"] | bits_meet(YEAR_BITS, "psc_years", words("owner_years", YEAR_BITS)))
    officer_any = bits_meet(YEAR_BITS, "officer_years", words("officer_years", YEAR_BITS))
    violation = F.coalesce((F.col("psc_year_max") > tests["newest"]), F.lit(False)) | F.coalesce(F.col("psc_year_min") < tests["oldest"], F.lit(False))
    dated_officer = F.coalesce(F.col("officer_count"), F.lit(0)) > 0
    any_ok = ~tests["any_tenure"] | (owner_any & officer_any)
    strict_ok = ~tests["strict"] | (~violation & dated_officer)
    return sic_ok & age_ok & any_ok & strict_ok


def enrich_with_profiles(base: DataFrame, profiles: DataFrame, broadcast_profiles: bool = False,
                         key: str = "CompanyNumber") -> DataFrame:
    """A5 from profiles: LEFT join on the company number (broadcast only when
    the caller bounded the profile side)."""
    prof = profiles.drop("geo_lat", "geo_long")
    if key != PROFILE_KEY:
        prof = prof.withColumnRenamed(PROFILE_KEY, key)
    return base.join(F.broadcast(prof) if broadcast_profiles else prof, key, "left")
