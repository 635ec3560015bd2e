"""Point lookup by stored key, skew-split geocoding, distributed selection, page index."""

import pytest
from pyspark.sql import functions as F

from prospect.operators import geo as G
from prospect.operators import output as O
from prospect.session import scratch_path
from prospect.sources.writers import write_parquet
from tests.test_large_path import no_broadcast
from tests.test_plans import plan


def directory(spark, n=20_000):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.format_string("P%05d", k), F.lit(" 1aa")).alias("pcds"), (F.lit(50.0) + k * 7919 % n / n).alias("lat"),
        (F.lit(-3.0) + k * 104729 % n / n).alias("long"))


# --- G2 -------------------------------------------------------------------------

def scanned_rows(df):
    """Rows that the executed plan's scans gave out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in node.nodeName():
        node = node.executedPlan()
    todo, total = [node], 0
    while todo:
        x = todo.pop()
        if "QueryStage" in x.nodeName():
            todo.append(x.plan())
        if x.nodeName().startswith("Scan parquet"):
            total += x.metrics().apply("numOutputRows").value()
        children = x.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_lookup_reads_the_row_groups_that_can_hold_the_postcode(spark):
    path = scratch_path(spark, "keyed-postcodes")
    keyed = G.with_stored_key(directory(spark), "pcds")
    write_parquet(keyed.repartitionByRange(4, "lat"), path, row_group_rows=500, sort_within=["lat"], bloom=G.STORED_KEY)
    stored = spark.read.parquet(path)
    found = G.postcode_lookup(stored, "p00042 1AA")
    assert f"EqualTo({G.STORED_KEY},P000421AA)" in plan(found)
    assert [r["pcds"] for r in found.collect()] == ["P00042 1aa"]
    assert scanned_rows(stored.where(F.col(G.STORED_KEY) == "P000421AA")) <= 2 * 500
    assert G.postcode_lookup(stored, "ZZ1 1ZZ").collect() == []
    plain = directory(spark)
    assert G.postcode_lookup(plain, "p00042 1AA").collect() == found.collect()


# --- G3 -------------------------------------------------------------------------

def test_a_postcode_with_a_third_of_all_companies_is_split(spark):
    n = 12_000
    k = F.col("id")
    companies = spark.range(n).select(
        F.format_string("C%06d", k).alias("CompanyNumber"),
        F.when(k % 3 == 0, F.lit("P00001 1AA")).when(k % 97 == 0, F.lit(None)).otherwise(F.format_string("p%05d1aa", k)).alias("RegAddressPostCode"))
    postcodes = directory(spark, 20_000)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    with no_broadcast(spark):
        try:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            placed = G.geocode_companies(companies, postcodes)
            tasks = sorted(r["n"] for r in placed.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect())
            got = {(r["CompanyNumber"], r["lat"]) for r in placed.collect()}
        finally:
            for c, v in old.items():
                spark.conf.set(c, v)
    want = G.geocode_companies(companies, postcodes, broadcast_postcodes=True)
    assert got == {(r["CompanyNumber"], r["lat"]) for r in want.collect()} and len(got) == sum(tasks)
    assert tasks[-1] <= 2 * tasks[len(tasks) // 2]
    assert placed.columns == [*companies.columns, "lat", "long"]


# --- O4 -------------------------------------------------------------------------

def result(spark, n=5_000):
    """Half of the rows lie at one distance."""
    k = F.col("id")
    return spark.range(n).select(
        F.format_string("C%06d", k * 7919 % n).alias("CompanyNumber"),
        F.when(k % 2 == 0, F.lit(3.25)).otherwise(k * 31 % 1000 / 10.0).alias("distance_miles"))


@pytest.mark.parametrize("n", [1, 100, 1777, 4999, 5000, 9000])
def test_large_limits_are_selected_without_one_task(spark, monkeypatch, n):
    df = result(spark)
    want = [tuple(r) for r in df.orderBy(*O.ORDER_KEYS).limit(n).collect()]
    assert n >= 5_000 or "TakeOrderedAndProject" in plan(O.nearest_top_n(df, n))
    monkeypatch.setattr(O, "TAKE_ROWS", 0)
    chosen = O.nearest_top_n(df, n)
    assert [tuple(r) for r in chosen.collect()] == want
    p = plan(chosen)
    assert "TakeOrderedAndProject" not in p and "GlobalLimit" not in p and "SinglePartition" not in p.split("BroadcastExchange")[0]


def test_selection_of_an_empty_result(spark, monkeypatch):
    monkeypatch.setattr(O, "TAKE_ROWS", 0)
    assert O.nearest_top_n(result(spark).limit(0), 5).collect() == []


# --- O5 -------------------------------------------------------------------------

def test_a_page_is_read_from_its_file_alone(spark):
    df, path = result(spark, 2_345), scratch_path(spark, "pages")
    manifest = O.write_pages(df, path, page_size=100, rows_per_file=500)
    rows = [tuple(r) for r in df.orderBy(*O.ORDER_KEYS).collect()]
    pages = {r["page"]: r for r in manifest.collect()}
    assert sorted(pages) == list(range(24)) and [pages[k]["file"] for k in range(24)] == [k // 5 for k in range(24)]
    assert all(pages[k]["first_row"] == 100 * k + 1 and pages[k]["rows"] == len(rows[100 * k:100 * k + 100]) for k in pages)
    for k in (0, 7, 23):
        page = O.read_page(spark, path, k)
        assert [tuple(r) for r in page.collect()] == rows[100 * k:100 * k + 100]
        assert len(page.inputFiles()) <= 2
    assert O.read_page(spark, path, 24).collect() == [] and O.read_page(spark, path, 24).columns == df.columns


def test_pages_of_an_empty_result(spark):
    path = scratch_path(spark, "no-pages")
    assert O.write_pages(result(spark).limit(0), path).count() == 0


def test_pages_follow_the_order_with_ties(spark):
    rows = O.result_pages(result(spark, 900), page_size=64).orderBy("row_in_result").collect()
    want = [tuple(r) for r in result(spark, 900).orderBy(*O.ORDER_KEYS).collect()]
    assert [(r["CompanyNumber"], r["distance_miles"]) for r in rows] == want
    assert [r["page"] for r in rows] == [k // 64 for k in range(900)]
