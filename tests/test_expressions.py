"""Scalar expressions: postcode normalisation, distance, rounding, years, code parsing."""

import math

import pytest
from pyspark.sql import functions as F

from prospect.functions import expressions as E


def one(spark, expr, value=None, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")) if callable(expr) else expr).first()[0]


def test_normalise_postcode_blanks_only(spark):
    assert one(spark, E.normalise_postcode, " sw1a 1aa ") == "SW1A1AA"
    assert one(spark, E.normalise_postcode, "sw1a\t1aa") == "SW1A\t1AA"  # tabs are kept
    assert one(spark, E.normalise_postcode, None) is None


def test_haversine_known_distance(spark):
    # London (51.5074, -0.1278) to Paris (48.8566, 2.3522): about 213.6 miles on R = 3959.
    d = spark.range(1).select(E.haversine_miles(51.5074, -0.1278, F.lit(48.8566), F.lit(2.3522))).first()[0]
    assert 213 < d < 214.5
    same = spark.range(1).select(E.haversine_miles(51.5, -0.1, F.lit(51.5), F.lit(-0.1))).first()[0]
    assert same == 0.0


def test_round_half_away_matches_duckdb_round(spark):
    import random

    import duckdb

    rnd = random.Random(7)
    values = [1.005, 0.125, 2.675, 3.14159, 0.0, 12.345] + [rnd.uniform(0, 500) for _ in range(3000)]
    values += [round(rnd.uniform(0, 500), 3) for _ in range(3000)]  # many exact-looking halves
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(E.round_half_away(F.col("v"), 2)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute("SELECT ROUND(v, 2) FROM t ORDER BY i").fetchall()]
    assert got == want
    assert got[0] == 1.0  # Spark's own round() would give 1.01


@pytest.mark.parametrize("value,year", [(20140801, 2014), (19991231, 1999), (10000000, 1000), (99999999, 9999),
                                        (2014081, 2014), (201408011, 2014), (-2014080, -201), (123, 123),
                                        (None, None)])
def test_yyyymmdd_year_is_the_first_four_characters(spark, value, year):
    assert one(spark, E.yyyymmdd_year, value, "bigint") == year


def test_year_diff_calendar_years(spark):
    df = spark.createDataFrame([("2000-12-31",)], "d string").select(F.to_date("d").alias("d"))
    assert df.select(E.year_diff(E.as_of_date("2025-01-01"), "d")).first()[0] == 25


@pytest.mark.parametrize("text,code,desc", [
    ("62012 - Business and domestic software development", 62012, "Business and domestic software development"),
    ("01110 - Growing of cereals - except rice", 1110, "Growing of cereals"),
    ("99999", 99999, ""),
    ("None Supplied", None, ""),
    ("62012.7 - odd", None, "odd"),      # Spark's try_cast is stricter than the reference engine's
    ("", None, ""),
])
def test_split_sic_text(spark, text, code, desc):
    df = spark.createDataFrame([(text,)], "t string")
    c, d = E.split_sic_text(F.col("t"))
    row = df.select(c, d).first()
    assert row[0] == code
    assert row[1] == desc


def test_bounding_box_covers_circle():
    lat0, lon0, r = 51.5, -0.1, 100.0
    lo, hi = E.latitude_box(lat0, r)
    half = E.longitude_half_width(lat0, r)
    # Points exactly r miles due north / east are inside the box.
    assert hi - lat0 > r / 69.098
    assert half > r / (69.098 * math.cos(math.radians(lat0)))
    assert E.longitude_half_width(88.9, 50.0) is None
