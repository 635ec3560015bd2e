"""Plan assertions: the physical shapes the design relies on."""

from prospect.operators import matching as J
from prospect.operators.geo import lookup_target
from prospect.plans import batch as B
from prospect.plans.search import SearchRequest, candidates

AS_OF = "2025-06-30"


def plan(df):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_single_search_pushes_box_and_status_to_scans(small_tables):
    t = small_tables
    lat, lon, _ = lookup_target(t.postcodes, "AB24 0AQ")
    p = plan(candidates(t, SearchRequest("AB24 0AQ", 40.0), (lat, lon), AS_OF))
    assert "GreaterThanOrEqual(geo_lat," in p and "LessThanOrEqual(geo_long," in p
    assert "Join" not in p  # the companies' own coordinates: no postcode join
    assert "EqualTo(CompanyStatus,Active)" in p
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_semi_and_anti_joins(small_tables):
    t = small_tables
    base = t.companies
    assert "LeftSemi" in plan(J.filter_sic_any(base, t.company_sic, [62020]))
    assert "LeftAnti" in plan(J.filter_psc_tenure_strict(base, t.psc, t.officers, AS_OF, 5, None))


def test_batch_radius_join_is_an_equi_join(spark, small_tables):
    from prospect.sources.schemas import REQUESTS

    rows = [{**{f.name: None for f in REQUESTS.fields}, "request_id": f"r{i}", "postcode": pc, "radius_miles": r}
            for i, (pc, r) in enumerate([("AB24 0AQ", 10.0), ("AB30 0AQ", 40.0), ("AB11 0AQ", 120.0),
                                         ("AB24 0AQ", 0.5), ("AB64 1AQ", 3.0), ("AB11 0AQ", 500.0)])]
    located = B.locate_requests(B.validate_requests(B.resolve_requests(spark.createDataFrame(rows, REQUESTS))),
                                small_tables.postcodes)
    pairs = B.pairs_within(located, small_tables.postcodes)
    p = plan(pairs)
    assert "NestedLoop" not in p and "CartesianProduct" not in p
    assert "cx" in p and "cy" in p and "level" in p
    assert "GreaterThanOrEqual(lat," in p  # the batch's covering box reaches the postcode scan
    # the grid join finds exactly the pairs a brute-force cross product finds
    from pyspark.sql import functions as F

    from prospect.functions.expressions import haversine_miles

    brute = located.where("found").crossJoin(small_tables.postcodes.select("pcds", "lat", "long")).where(
        haversine_miles(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("long")) <= F.col("radius_miles"))
    assert pairs.count() == brute.count()
    assert pairs.select("request_id", "lat", "long").exceptAll(brute.select("request_id", "lat", "long")).count() == 0


def test_location_layout_prunes_every_scan(small_tables):
    """Prepared with the location layout and profiles, a search pushes its
    box into the companies and profile scans and aggregates nothing; without
    prepared profiles the box still reaches every detail-table scan."""
    from prospect.plans.search import enriched_matches
    from prospect.sources.tables import Tables

    t = small_tables
    assert "geo_lat" in t.profiles.columns and "geo_lat" in t.companies.columns
    req = SearchRequest("AB24 0AQ", 10.0, min_psc_age=60)
    lat, lon, _ = lookup_target(t.postcodes, req.postcode)
    base = candidates(t, req, (lat, lon), AS_OF)
    p = plan(enriched_matches(t, req, base, 10, AS_OF, area=(lat, lon, 10.0)))
    assert "company_profiles.parquet" in p and "Aggregate" not in p
    assert p.count("GreaterThanOrEqual(geo_lat,") >= 2   # companies, profiles
    no_profiles = Tables(t.companies, t.company_sic, t.postcodes, t.psc, t.officers)
    p = plan(enriched_matches(no_profiles, req, base, 10, AS_OF, area=(lat, lon, 10.0)))
    assert p.count("Exchange hashpartitioning") <= 1      # one aggregation builds the profile
    assert "LeftSemi" in p                                 # detail tables pruned to the candidates


def test_location_layout_gives_identical_results(spark, small_tables):
    from prospect.plans.registry import SEARCHES
    from prospect.plans.search import search
    from prospect.sources.fixtures import fixture_tables

    plain = fixture_tables(spark, "/root/testdata/sf0.001", AS_OF)
    for name in ["search_basic", "search_all_filters", "search_tenure_strict", "search_dissolved_wide"]:
        a = search(small_tables, SEARCHES[name], AS_OF).collect()
        b = search(plain, SEARCHES[name], AS_OF).collect()
        assert a == b, name


def test_plain_layout_gives_identical_results(spark, small_tables):
    """prepare_all without the location layout (profiles still prepared)
    returns exactly the rows of the laid-out tables."""
    from prospect.plans.pipeline import RawSources, prepare_all
    from prospect.plans.registry import SEARCHES
    from prospect.plans.search import search
    from prospect.session import scratch_path
    from prospect.sources import fixtures as FX

    sf = "/root/testdata/sf0.001"
    plain = prepare_all(spark, RawSources(FX.companies_raw(spark, sf), FX.psc_raw(spark, sf),
                                          FX.postcodes_raw(spark, sf), FX.officers_raw(spark, sf)),
                        scratch_path(spark, "plain-layout"), AS_OF, geo_layout=False)
    assert plain.profiles is not None and "geo_lat" not in plain.companies.columns
    for name in ["search_basic", "search_all_filters", "search_tenure_any"]:
        assert search(plain, SEARCHES[name], AS_OF).collect() == search(small_tables, SEARCHES[name], AS_OF).collect()


def test_batch_reads_the_companies_own_coordinates(spark, small_tables):
    """With the location layout the batch joins no postcode; without it the
    postcode join returns the same rows."""
    from dataclasses import replace

    from prospect.sources import fixtures as FX

    sf = "/root/testdata/sf0.001"
    located = B.locate_requests(B.validate_requests(B.resolve_requests(FX.requests_raw(spark, sf), FX.profiles(spark, sf))),
                                small_tables.postcodes)
    located = B.materialize(located, "test-located")
    plain = replace(small_tables, companies=small_tables.companies.drop("geo_lat", "geo_long"))
    own, joined = B.search_many(small_tables, located, AS_OF), B.search_many(plain, located, AS_OF)
    assert "postcodes.parquet" not in plan(own) and "postcodes.parquet" in plan(joined)
    cols = ["request_id", "CompanyNumber", "distance_miles"]
    a, b = (sorted(map(tuple, df.select(*cols).collect())) for df in (own, joined))
    assert a == b and a


def test_batch_pairs_are_made_by_the_last_join(spark, small_tables):
    """Without prepared coordinates or profiles, companies get both before they
    meet the requests: pairs are neither shuffled, joined again nor written."""
    from dataclasses import replace

    from prospect.sources import fixtures as FX
    from tests.test_large_path import no_broadcast

    sf = "/root/testdata/sf0.001"
    plain = replace(small_tables, companies=small_tables.companies.drop("geo_lat", "geo_long"), profiles=None, search=None)
    with no_broadcast(spark):
        located = B.materialize(B.locate_requests(B.validate_requests(B.resolve_requests(FX.requests_raw(spark, sf), FX.profiles(spark, sf))),
                                                  plain.postcodes), "test-located")
        for found in (B.search_many(plain, located, AS_OF), B.search_many_filters(plain, located.where("max_results IS NULL"), AS_OF)):
            above, _, below = found._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")
            assert below.startswith(" [level"), below[:100]
            assert "Exchange" not in above and "many-matches" not in above + below
