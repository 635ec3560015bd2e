"""The pre-joined search table, bit-set profiles and the skew-adaptive grid."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from prospect.functions.expressions import haversine_miles
from prospect.operators import aggregates as A
from prospect.operators.skew import blocks, deal, hot_splits, unpacked
from prospect.plans import batch as B
from prospect.plans.registry import SEARCHES
from prospect.plans.search import SearchRequest, search, search_unordered
from prospect.sources import fixtures as FX
from prospect.sources.schemas import REQUESTS
from tests.test_large_path import no_broadcast
from tests.test_plans import plan

AS_OF = "2025-06-30"
SF = "/root/testdata/sf0.001"


def located_requests(spark, tables):
    return B.materialize(B.locate_requests(B.validate_requests(B.resolve_requests(FX.requests_raw(spark, SF), FX.profiles(spark, SF))),
                                           tables.postcodes), "test-located")


# --- pre-joined table -----------------------------------------------------------

def test_a_search_is_one_scan_of_the_search_table(small_tables):
    req = SearchRequest("AB24 0AQ", 40.0, sic_codes=(62020,), min_psc_age=60, min_psc_tenure_years=3)
    p = plan(search_unordered(small_tables, req, AS_OF))
    assert "company_search.parquet" in p and "company_profiles.parquet" not in p and "companies.parquet" not in p
    assert "Join" not in p and "Exchange" not in p and "Aggregate" not in p
    assert "GreaterThanOrEqual(geo_lat," in p and "EqualTo(CompanyStatus,Active)" in p


@pytest.mark.parametrize("broadcast", [True, False])
def test_batch_pairs_meet_no_profile_join(spark, small_tables, broadcast):
    located = located_requests(spark, small_tables)
    conditions = A.profile_conditions(AS_OF, F.col("sic_codes"), F.col("min_psc_age"), F.col("max_psc_age"), F.col("req_min_tenure"),
                                      F.col("req_max_tenure"), F.col("strict_psc_tenure"))

    def matched():
        pairs = B.search_many(small_tables, located.withColumnsRenamed(B.TENURE_BOUNDS), AS_OF, profiled=True)
        return plan(pairs.where(conditions))

    if broadcast:
        p = matched()
        assert "BroadcastHashJoin" in p and "hashpartitioning(" not in p
    else:
        with no_broadcast(spark):
            p = matched()
    assert "hashpartitioning(CompanyNumber" not in p and "company_profiles.parquet" not in p and "NestedLoop" not in p


def test_searches_equal_those_without_the_search_table(spark, small_tables):
    plain = replace(small_tables, search=None)
    for name, req in SEARCHES.items():
        assert search(small_tables, req, AS_OF).collect() == search(plain, req, AS_OF).collect(), name


def test_batches_equal_those_without_the_search_table(spark, small_tables):
    def run(t):
        _, _, results, counts = B.run_requests(t, FX.requests_raw(spark, SF), FX.profiles(spark, SF), AS_OF)
        return sorted(map(repr, results.collect())), sorted(map(repr, counts.collect()))

    with_table = run(small_tables)
    assert with_table == run(replace(small_tables, search=None)) and with_table[0]
    with no_broadcast(spark):
        assert run(small_tables) == with_table


# --- bit sets --------------------------------------------------------------------

def test_bit_sets_hold_what_sets_hold(spark):
    rng = random.Random(4)
    groups = {g: [rng.choice([None, -3, 0, 15, 16, 63, 64, 100, 120, 127, 128, 400]) for _ in range(rng.randrange(0, 6))] for g in range(40)}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    sets = spark.createDataFrame(rows, "g int, v int").groupBy("g").agg(*A.bit_set(F.col("v"), A.AGE_BITS, "s"))
    held = {r["g"]: r["x"] for r in sets.select("g", A.bit_values(A.AGE_BITS, "s").alias("x")).collect()}
    for g, values in held.items():
        assert values == sorted({min(max(v, 0), 127) for v in groups[g] if v is not None})
    for lo, hi in [(None, None), (17, None), (None, 119), (16, 63), (64, 64), (63, 64), (90, 30)]:
        got = {r["g"]: r["x"] for r in sets.select("g", A.bits_between(A.AGE_BITS, "s", F.lit(lo).cast("int"), F.lit(hi).cast("int")).alias("x")).collect()}
        assert got == {g: any(v is not None and (lo is None or v >= lo) and (hi is None or v <= hi) for v in groups[g]) for g in held}, (lo, hi)


def test_people_are_folded_by_hash_aggregation(spark, small_tables):
    p = plan(A.people_profiles(small_tables.psc, small_tables.officers))
    assert "HashAggregate" in p and "ObjectHashAggregate" not in p and "SortAggregate" not in p
    assert p.count("hashpartitioning(CompanyNumber") == 1


def test_profiles_of_companies_in_one_table_only(spark):
    sic = spark.createDataFrame([("A", 62020, "Software", 1), ("A", 62090, "Other", 2)], "CompanyNumber string, sic_code int, sic_description string, sic_position int")
    psc = spark.createDataFrame([("B", 61, dt.date(2001, 5, 1)), ("B", None, None)], "company_number string, approximate_age int, notified_on date")
    officers = spark.createDataFrame([("C", 19991231), ("C", None)], "company_number string, appointment_date long")
    rows = {r["CompanyNumber"]: r for r in A.company_profiles(sic, psc, officers).collect()}
    assert sorted(rows["A"]["sic_code_set"]) == [62020, 62090] and rows["A"]["psc_count"] == rows["A"]["officer_count"] == 0
    assert rows["B"]["sic_code_set"] == [] and rows["B"]["psc_count"] == 2 and rows["B"]["psc_year_n"] == 1
    assert rows["C"]["officer_count"] == 1 and rows["C"]["officer_year_min"] == 1999 and rows["C"]["psc_ages_0"] == 0


# --- grid ------------------------------------------------------------------------

def crowd(spark, n=6000):
    """Companies of which a third share one spot and the others lie across 8 degrees."""
    k = F.col("id")
    hot = k % 3 == 0
    return spark.range(n).select(
        F.format_string("C%06d", "id").alias("CompanyNumber"),
        F.when(hot, F.lit(51.5)).otherwise(F.lit(50.0) + (k * 37 % 1000) / 125.0).alias("lat"),
        F.when(hot, F.lit(-0.1)).otherwise(F.lit(-5.0) + (k * 91 % 1000) / 125.0).alias("long"))


def wide_requests(spark, n=1000, radius=500.0):
    base = {f.name: None for f in REQUESTS.fields}
    rows = [{**base, "request_id": f"r{i}", "postcode": "AB1 1AA", "radius_miles": radius} for i in range(n)]
    k = F.regexp_extract("request_id", r"(\d+)", 1).cast("int")
    return spark.createDataFrame(rows, REQUESTS).withColumns({
        "found": F.lit(True), "t_lat": F.lit(50.5) + (k % 30) / 10.0, "t_lon": F.lit(-4.0) + (k % 17) / 4.0})


def test_a_thousand_wide_requests_stay_balanced(spark):
    companies, requests = crowd(spark), wide_requests(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    with no_broadcast(spark):
        try:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            levels = [9]
            met = B.meet(requests, companies, levels, "CompanyNumber", requests.count())
            tasks = [r["n"] for r in met.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
    brute = requests.select("t_lat", "t_lon").crossJoin(companies).where(
        haversine_miles(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("long")) <= 500.0).count()
    assert sum(tasks) == brute and len(tasks) == 8
    assert max(tasks) <= 4 * sorted(tasks)[len(tasks) // 2]


def test_split_cells_keep_every_pair(spark):
    companies = crowd(spark, 900)
    requests = wide_requests(spark, 40, 60.0).withColumn("radius_miles", F.when(F.col("request_id") < "r2", F.lit(3.0)).otherwise(F.lit(60.0)))
    stats = B.batch_stats(requests)
    with no_broadcast(spark):
        met = B.meet(requests, companies, stats["levels"], "CompanyNumber", stats["requests"]).select("request_id", "CompanyNumber")
        rows = met.collect()
    brute = requests.crossJoin(companies).where(
        haversine_miles(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("long")) <= F.col("radius_miles")).select("request_id", "CompanyNumber").collect()
    assert sorted(rows) == sorted(brute) and rows


def test_splits_are_few_and_cover_the_share(spark):
    companies, requests = crowd(spark, 900), wide_requests(spark, 50, 60.0)
    level = B.batch_stats(requests)["levels"]
    asked, held = B.request_cells(requests, level).select(*B.CELL), B.point_cells(companies, level).select(*B.CELL)
    cells = {(r["cx"], r["cy"]): r["n"] for r in held.groupBy("cx", "cy").agg(F.count("*").alias("n")).collect()}
    asks = {(r["cx"], r["cy"]): r["n"] for r in asked.groupBy("cx", "cy").agg(F.count("*").alias("n")).collect()}
    pairs = {c: n * asks[c] for c, n in cells.items() if c in asks}
    splits = hot_splits(asked, held, B.CELL, 16).collect()
    share = max(1, sum(pairs.values()) // 16)
    assert len(splits) < 17 and {(r["cx"], r["cy"]): r["pieces"] for r in splits} == {
        c: min(cells[c], -(-p // share)) for c, p in pairs.items() if p > share}
    assert hot_splits(asked.limit(0), held, B.CELL, 16) is None


def test_pairs_on_the_radius_and_points_nowhere(spark):
    """Stored products leave pairs within rounding of the radius to the distance itself,
    and points without coordinates meet nobody, in both plans."""
    rng = random.Random(7)
    points = [(f"C{i:04}", 51.0 + rng.random() / 5, -1.0 + rng.random() / 5) for i in range(300)]
    points += [("N1", None, -1.0), ("N2", 51.1, None), ("N3", float("nan"), -1.0), ("N4", None, None)]
    companies = spark.createDataFrame(points, "CompanyNumber string, lat double, long double")
    spots = spark.createDataFrame([(51.0 + rng.random() / 5, -1.0 + rng.random() / 5) for _ in range(6)], "t_lat double, t_lon double")
    away = spots.crossJoin(companies.where("lat > 0 AND long < 0")).select(
        "t_lat", "t_lon", haversine_miles(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("long")).alias("radius_miles")).collect()
    # Each radius is a pair's distance, the next double below it, or close to nothing.
    asked = [(f"r{i}", r["t_lat"], r["t_lon"], d, True) for i, r in enumerate(rng.sample(away, 40))
             for d in [r["radius_miles"] if i % 2 else math.nextafter(r["radius_miles"], 0.0)]]
    asked += [("zero", points[0][1], points[0][2], 0.0, True), ("hair", points[1][1], points[1][2], 1e-7, True)]
    requests = spark.createDataFrame(asked, "request_id string, t_lat double, t_lon double, radius_miles double, found boolean").withColumn("max_results", F.lit(None).cast("int"))
    stats = B.batch_stats(requests)
    brute = sorted(requests.crossJoin(companies.where("lat > 0 AND long < 0")).where(
        haversine_miles(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("long")) <= F.col("radius_miles")).select("request_id", "CompanyNumber").collect())
    few = B.meet(requests, companies, stats["levels"], "CompanyNumber", stats["requests"])
    with no_broadcast(spark):
        many = B.meet(requests, companies, stats["levels"], "CompanyNumber", stats["requests"])
        assert "posexplode(_rows" in plan(many) and "ASIN" not in plan(many.select("request_id")).split("_least")[0]
        rows = many.select("request_id", "CompanyNumber", "distance_miles").collect()
    assert sorted((r[0], r[1]) for r in rows) == [tuple(r) for r in brute]
    assert sorted(few.select("request_id", "CompanyNumber", "distance_miles").collect()) == sorted(rows)
    assert ("zero", "C0000") in [tuple(r) for r in brute] and ("hair", "C0001") in [tuple(r) for r in brute]


def test_blocks_are_bounded_and_lose_no_row(spark):
    """A key of few pairs but many rows is split by its rows too; lists keep NULLs in place."""
    held = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("name"),
                                    F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("twice"))
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "k int, who string")
    splits = hot_splits(asked.select("k"), held.select("k"), ["k"], 1, 100)
    assert splits.collect()[0]["pieces"] == 50 and hot_splits(asked.select("k"), held.select("k"), ["k"], 1).count() == 0
    copied, dealt, on = deal(asked, held, ["k"], splits, "n")
    packed = blocks(dealt, on)
    assert max(r[0] for r in packed.select(F.size("_rows")).collect()) < 200
    found = unpacked(copied.join(packed, on), dealt, on).select("who", "n", "name", "twice").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == [
        ("a", i, str(i) if i % 3 else None, 2 * i if i % 5 else None) for i in range(5000)]


def test_limits_are_met_in_rounds(spark, small_tables, monkeypatch):
    """Requests with a limit look near their target first; whatever the rounds take,
    the rows are those of the whole radius."""
    located = located_requests(spark, small_tables).withColumn("radius_miles", F.least(F.col("radius_miles") * 4, F.lit(500.0)))
    # Two limits that are met nearby, in part, or not at all.
    located = B.materialize(located.withColumn("max_results", F.when(F.col("request_id") < "R000050", F.lit(2)).otherwise(F.col("max_results"))), "test-limits")

    def run():
        return sorted(map(repr, B.search_many_filters(small_tables, located, AS_OF).collect()))

    few, stages = run(), []
    monkeypatch.setattr(B, "materialize", lambda df, name="stage", kept=B.materialize: stages.append(name) or kept(df, name))
    with no_broadcast(spark):
        assert run() == few and few and "many-nearest" not in stages
        monkeypatch.setattr(B, "ROUND_PAIRS", 0)
        for rounds in [(0, 8), (0, 1, 2), (1 << 20, 1)]:
            monkeypatch.setattr(B, "ROUND_CANDIDATES", rounds)
            stages.clear()
            assert run() == few
            # Without a cell of a million companies the first round takes the whole radius.
            assert stages.count("many-nearest") == 1 if rounds[0] else stages.count("many-nearest") > 1


def test_repeated_ids_take_no_rounds(spark, small_tables, monkeypatch):
    located = located_requests(spark, small_tables).where("found AND max_results > 0")
    twice, stages = B.materialize(located.unionByName(located.limit(3)), "test-twice"), []

    def run():
        return sorted(map(repr, B.search_many_filters(small_tables, twice, AS_OF).collect()))

    with no_broadcast(spark):
        whole = run()
        monkeypatch.setattr(B, "ROUND_PAIRS", 0)
        monkeypatch.setattr(B, "materialize", lambda df, name="stage", kept=B.materialize: stages.append(name) or kept(df, name))
        assert run() == whole and whole and stages and "many-nearest" not in stages
