"""Prepare stage on hand-made rows (traps of the reference included)."""

import datetime as dt

from pyspark.sql import functions as F

from prospect.operators import prepare as P
from prospect.sources import schemas


def company_rows(spark, rows):
    cols = [n for n, _ in schemas.COMPANY_CSV_FIELDS]
    full = [{c: r.get(c) for c in cols} for r in rows]
    return spark.createDataFrame(full, schemas.COMPANY_CSV)


def test_companies_projection_drops_missing_number(spark):
    raw = company_rows(spark, [
        {"CompanyNumber": "00000001", "CompanyName": "A", "RegAddress.PostCode": "AB1 2CD"},
        {"CompanyNumber": None, "CompanyName": "B"},
    ])
    out = P.prepare_companies(raw)
    assert out.columns == [f.name for f in schemas.COMPANIES.fields]
    rows = out.collect()
    assert [r.CompanyNumber for r in rows] == ["00000001"]
    assert rows[0].RegAddressPostCode == "AB1 2CD"


def test_sic_unpivot_positions_and_parse_failures(spark):
    raw = company_rows(spark, [
        {"CompanyNumber": "1", "SICCode.SicText_1": "None Supplied", "SICCode.SicText_2": "62020 - IT",
         "SICCode.SicText_4": "62020 - IT again"},
        {"CompanyNumber": "2", "SICCode.SicText_1": "01110 - Cereals - except rice"},
    ])
    out = sorted((r.CompanyNumber, r.sic_code, r.sic_description, r.sic_position)
                 for r in P.prepare_company_sic(raw).collect())
    assert out == [("1", 62020, "IT", 2), ("1", 62020, "IT again", 4), ("2", 1110, "Cereals", 1)]


def test_postcodes_live_and_unique(spark):
    raw = spark.createDataFrame([
        ("AB1 2CD", 51.0, -1.0, "E1", None),
        ("ab12cd", 52.0, -1.0, "E2", None),      # same normalised postcode: smallest pcds wins
        ("AB9 9ZZ", None, -1.0, "E3", None),     # no latitude
        ("AB8 8ZZ", 51.0, -1.0, "E4", "202001"),  # terminated
    ], schemas.POSTCODE_CSV)
    out = P.prepare_postcodes(raw).collect()
    assert [(r.pcds, r.lat) for r in out] == [("AB1 2CD", 51.0)]
    assert P.prepare_postcodes(raw, dedupe=False).count() == 2


def test_psc_keeps_active_individuals_with_birth_year(spark):
    ind = "individual-person-with-significant-control"
    rows = [
        ("1", ("Ann", ind, (1960, 5), "British", ["x"], dt.date(2016, 4, 6), None)),
        ("1", ("Corp", "corporate-entity-person-with-significant-control", (1960, 5), None, [], None, None)),
        ("2", ("Bob", ind, (1950, 1), "Irish", [], dt.date(2017, 1, 1), dt.date(2020, 1, 1))),
        ("3", ("Cy", ind, None, "Irish", [], None, None)),
    ]
    raw = spark.createDataFrame(rows, schemas.PSC_JSON)
    out = P.prepare_psc(raw, "2025-06-30").collect()
    assert len(out) == 1
    r = out[0]
    assert (r.company_number, r.name, r.birth_year, r.approximate_age) == ("1", "Ann", 1960, 65)
    assert r.natures_of_control == ["x"]


def test_location_layout_spreads_a_hot_company(spark):
    """A company holding a third of all rows (same location, same name) is
    spread over several output files, not written by one task."""
    import glob

    import pyarrow.parquet as pq

    from prospect.plans.pipeline import write_by_location
    from prospect.session import scratch_path

    hot = spark.range(3000).select(F.lit("HOT").alias("company_number"), F.lit("Same Name").alias("name"),
                                   F.lit(51.5).alias("geo_lat"), F.lit(-0.1).alias("geo_long"),
                                   F.col("id").alias("v"))
    rest = spark.range(6000).select(F.format_string("C%05d", "id").alias("company_number"),
                                    F.lit("Other").alias("name"),
                                    (F.lit(50.0) + F.col("id") / 1000).alias("geo_lat"),
                                    F.lit(-1.0).alias("geo_long"), F.col("id").alias("v"))
    path = scratch_path(spark, "hot-layout")
    write_by_location(hot.unionByName(rest), path, 8, ["company_number", "name"])
    files = glob.glob(path.replace("file:", "", 1) + "/*.parquet")
    counts = sorted(pq.ParquetFile(f).metadata.num_rows for f in files)
    assert sum(counts) == 9000
    assert counts[-1] < 3000  # the hot company's rows are split


def test_prepare_from_raw_folder_picks_newest_snapshots(spark):
    """Setup end to end: a raw folder holding an older and a newer snapshot of
    each source; the newest (by date, not by name) is prepared."""
    from prospect.plans.pipeline import prepare_all, raw_sources_from_folder
    from prospect.plans.registry import write_postcodes_csv
    from prospect.session import scratch_path
    from prospect.sources import fixtures as FX

    sf = "/root/testdata/sf0.001"
    raw = scratch_path(spark, "raw-folder")
    companies = FX.companies_raw(spark, sf).withColumnRenamed("CompanyNumber", " CompanyNumber")
    (companies.limit(10).write.option("header", True).option("dateFormat", "dd/MM/yyyy")
     .csv(f"{raw}/BasicCompanyDataAsOneFile-2024-12-01.csv"))
    companies.write.option("header", True).option("dateFormat", "dd/MM/yyyy").csv(
        f"{raw}/BasicCompanyDataAsOneFile-2025-06-01.csv")
    FX.psc_raw(spark, sf).write.option("dateFormat", "yyyy-MM-dd").json(
        f"{raw}/persons-with-significant-control-snapshot-2025-06-01.txt")
    write_postcodes_csv(spark, FX.postcodes_raw(spark, sf).limit(5), raw, "NOV_2024")
    write_postcodes_csv(spark, FX.postcodes_raw(spark, sf), raw, "FEB_2025")
    t = prepare_all(spark, raw_sources_from_folder(spark, raw), scratch_path(spark, "from-folder"), "2025-06-30")
    assert t.companies.count() == 150
    assert t.postcodes.count() == FX.postcodes_raw(spark, sf).where(
        "lat IS NOT NULL AND long IS NOT NULL AND doterm IS NULL").count()
    assert t.psc.count() > 0 and t.profiles.count() > 0
