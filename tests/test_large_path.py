"""The plans taken beyond the broadcast budget (the path that runs at scale)
give the same rows as the small-data path."""

import contextlib

import pytest

from prospect.plans import batch as B
from prospect.plans.registry import SEARCHES
from prospect.plans.search import search
from prospect.sources import fixtures as FX

AS_OF = "2025-06-30"
SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["search_basic", "search_all_filters", "search_tenure_strict", "search_categories"])
def test_single_search_shuffle_path(spark, small_tables, name):
    small = search(small_tables, SEARCHES[name], AS_OF).collect()
    with no_broadcast(spark):
        df = search(small_tables, SEARCHES[name], AS_OF)
        large = df.collect()
    assert large == small


def test_batch_shuffle_path(spark, small_tables):
    def run():
        _, _, results, counts = B.run_requests(small_tables, FX.requests_raw(spark, SF), FX.profiles(spark, SF), AS_OF)
        return sorted(map(tuple, results.collect())), sorted(map(tuple, counts.collect()))

    small = run()
    with no_broadcast(spark):
        large = run()
    assert large == small
    assert len(small[0]) > 0


def test_hot_postcode_and_hot_company(spark):
    """One postcode holds a third of all companies and one company a third of
    all owners: results stay whole, and the broadcast and shuffle plans agree."""
    import datetime as dt

    from pyspark.sql import functions as F

    from prospect.plans.search import SearchRequest
    from prospect.sources import schemas
    from prospect.sources.tables import Tables

    n = 3000
    postcodes = spark.createDataFrame([("HOT 1AA", 51.5, -0.1, "E1")] + [
        (f"P{i:04d} 1AA", 51.5 + (i % 50) / 500.0, -0.1 + (i // 50) / 500.0, "E2") for i in range(1, 2 * n // 10)],
        schemas.POSTCODES)
    comps = spark.range(n).select(
        F.format_string("C%06d", "id").alias("CompanyNumber"), F.lit("Co").alias("CompanyName"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT 1AA"))
        .otherwise(F.format_string("P%04d 1AA", (F.col("id") % (2 * n // 10 - 1)) + 1)).alias("RegAddressPostCode"),
        F.lit("Active").alias("CompanyStatus"), F.lit("Private").alias("CompanyCategory"),
        F.lit("UK").alias("CountryOfOrigin"), F.lit(dt.date(2000, 1, 1)).alias("IncorporationDate"),
        F.lit("SMALL").alias("AccountCategory"), F.lit(None).cast("date").alias("AccountsNextDueDate"),
        F.lit(None).cast("date").alias("AccountsLastMadeUpDate"), F.lit(None).cast("date").alias("ConfStmtNextDueDate"),
        F.lit(None).cast("date").alias("ConfStmtLastMadeUpDate"))
    psc = spark.range(3 * n).select(
        F.when(F.col("id") < n, F.lit("C000000")).otherwise(F.format_string("C%06d", F.col("id") % n)).alias("company_number"),
        F.lit("Owner").alias("name"), F.lit("individual-person-with-significant-control").alias("kind"),
        F.lit(1960).alias("birth_year"), (F.lit(40) + F.col("id") % 40).cast("int").alias("approximate_age"),
        F.lit("British").alias("nationality"), F.array().cast("array<string>").alias("natures_of_control"),
        F.lit(dt.date(2015, 1, 1)).alias("notified_on"))
    sic = spark.createDataFrame([], schemas.COMPANY_SIC)
    officers = spark.range(n).select(F.format_string("C%06d", "id").alias("company_number"),
                                     F.lit(20100101).cast("bigint").alias("appointment_date"))
    t = Tables(comps, sic, postcodes, psc, officers)
    req = SearchRequest("HOT 1AA", 50.0, min_psc_age=70)
    small = search(t, req, AS_OF).collect()
    with no_broadcast(spark):
        large = search(t, req, AS_OF).collect()
    assert small == large
    hot = [r for r in small if r.CompanyNumber == "C000000"][0]
    assert hot.PscCount == n + 2 and hot.OldestPscAge == 79
    assert sum(1 for r in small if r.Postcode == "HOT 1AA") >= 1
    everyone = search(t, SearchRequest("HOT 1AA", 50.0), AS_OF)
    assert everyone.count() == n
    assert everyone.where("Postcode = 'HOT 1AA'").count() == n // 3
