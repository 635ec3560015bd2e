"""Postcode lookup, geocoding and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospect.functions.expressions import bounding_box, haversine_miles, normalise_postcode
from prospect.operators.skew import deal, hot_splits, shares

PC_KEY = "_pc"
#: Column of the prepared postcodes and companies that holds the normalised postcode.
STORED_KEY = "postcode_key"


def normalise_postcodes(df: DataFrame, column: str, alias: str = PC_KEY) -> DataFrame:
    """G1 as an operator: add the normalised form of ``column``."""
    return df.withColumn(alias, normalise_postcode(column))


def with_stored_key(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the normalised form of ``column`` as a column of its own, for
    the prepared tables: lookups and joins then need no expression on it."""
    return df.withColumn(STORED_KEY, normalise_postcode(column))


def key_of(df: DataFrame, column: str):
    """The stored key, or the expression where the table has none."""
    return F.col(STORED_KEY) if STORED_KEY in df.columns else normalise_postcode(column)


def python_normalise(postcode: str) -> str:
    """G1 for a single driver-side value (same rule)."""
    return postcode.upper().replace(" ", "")


def postcode_lookup(postcodes: DataFrame, postcode: str) -> DataFrame:
    """The directory row of one postcode (at most one row).

    Spelling is ignored (case, blanks).  Ties, impossible after the prepare
    stage's de-duplication, go to the smallest ``pcds``.  On the prepared table
    the test is an equality on the stored key, which reaches the scan: its Bloom
    filters leave the row groups that can hold the postcode.
    """
    return (
        postcodes.where(key_of(postcodes, "pcds") == F.lit(python_normalise(postcode)))
        .select("pcds", "lat", "long")
        .orderBy("pcds")
        .limit(1)
    )


def lookup_target(postcodes: DataFrame, postcode: str) -> tuple[float, float, str] | None:
    """G2 for the single-request search: one bounded row to the driver, so the
    target's coordinates become literals that push down into the scans."""
    rows = postcode_lookup(postcodes, postcode).collect()
    if not rows:
        return None
    r = rows[0]
    return float(r["lat"]), float(r["long"]), r["pcds"]


def postcode_keys(postcodes: DataFrame) -> DataFrame:
    """Postcodes keyed by their normalised form (lat / long kept)."""
    return postcodes.select(key_of(postcodes, "pcds").alias(PC_KEY), "lat", "long")


def geocode_companies(companies: DataFrame, postcodes: DataFrame, broadcast_postcodes: bool = False) -> DataFrame:
    """Companies with the coordinates of their registered postcode.

    The reference's LEFT JOIN followed by ``lat IS NOT NULL`` is an inner
    equi-join on the normalised postcode (the stored keys where both tables have
    them).  ``broadcast_postcodes`` is only set by callers that have checked the
    postcode side's size; otherwise companies are counted by postcode first, and
    a postcode with more than its share of them (a formation agent's) is split.
    """
    pcs = postcodes if PC_KEY in postcodes.columns else postcode_keys(postcodes)
    keyed = companies.withColumn(PC_KEY, key_of(companies, "RegAddressPostCode"))
    if broadcast_postcodes:
        return keyed.join(F.broadcast(pcs), PC_KEY, "inner").drop(PC_KEY)
    splits, on = hot_splits(pcs.select(PC_KEY), keyed.select(PC_KEY), [PC_KEY], shares(companies.sparkSession)), [PC_KEY]
    if splits is not None:
        pcs, keyed, on = deal(pcs, keyed, [PC_KEY], splits, "CompanyNumber")
    return keyed.join(pcs, on, "inner").drop(*on)


def haversine_distance(df: DataFrame, lat0: float, lon0: float, out: str = "distance_miles") -> DataFrame:
    """Distance in miles from a fixed target to each row's lat / long."""
    return df.withColumn(out, haversine_miles(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("long")))


def radius_filter(df: DataFrame, lat0: float, lon0: float, radius_miles: float, distance: str = "distance_miles") -> DataFrame:
    """Inclusive radius test on the unrounded distance, preceded by a
    literal bounding box on the raw coordinates (which reaches the Parquet
    scan, so row groups outside the box are never read)."""
    boxed = df.where(bounding_box(F.col("lat"), F.col("long"), lat0, lon0, radius_miles))
    if distance not in boxed.columns:
        boxed = haversine_distance(boxed, lat0, lon0, distance)
    return boxed.where(F.col(distance) <= F.lit(float(radius_miles)))


def postcodes_within(postcodes: DataFrame, lat0: float, lon0: float, radius_miles: float) -> DataFrame:
    """Live postcodes within the radius, keyed by normalised postcode, with
    their distance.  Filtering the (small) postcode side before the join is
    what the reference's plan does implicitly after predicate push-down."""
    return radius_filter(postcodes, lat0, lon0, radius_miles).select(
        key_of(postcodes, "pcds").alias(PC_KEY), "lat", "long", "distance_miles")


def within_area(df: DataFrame, lat0: float, lon0: float, radius_miles: float,
                lat: str = "geo_lat", lon: str = "geo_long") -> DataFrame:
    """Keep rows whose company lies in the circle's bounding box, when the
    table carries company coordinates (prepared with the location layout);
    otherwise return ``df`` unchanged.  Literal bounds reach the Parquet
    scan, which skips row groups outside the box.  Safe as a pre-filter:
    every company within the radius lies inside the box."""
    if lat not in df.columns or lon not in df.columns:
        return df
    return df.where(bounding_box(F.col(lat), F.col(lon), lat0, lon0, radius_miles))
