"""Scalar Column expressions shared by every operator.

All of them are built-in Spark functions, so they stay inside whole-stage
codegen; nothing here is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's (radius of the earth in miles,
# separator between a SIC code and its description).
EARTH_RADIUS_MILES = 3959
SIC_SEPARATOR = " - "

# Miles per degree of latitude is 3959 * pi / 180 = 69.098...; 69.0 errs on
# the generous side, so boxes built with it always cover the circle.
MILES_PER_DEGREE_LOWER = 69.0


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def as_of_date(as_of: _dt.date | str | None) -> Column:
    """The query's "today": an explicit literal date, or ``current_date()``."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def normalise_postcode(c) -> Column:
    """G1: upper case, blanks removed (only blanks, not tabs)."""
    return F.replace(F.upper(as_column(c) if not isinstance(c, str) else F.col(c)), F.lit(" "), F.lit(""))


def year_diff(as_of: Column, d) -> Column:
    """Calendar-year difference ``year(as_of) - year(d)`` as bigint."""
    d = F.col(d) if isinstance(d, str) else d
    return (F.year(as_of) - F.year(d)).cast("bigint")


def yyyymmdd_year(c) -> Column:
    """A4: year out of an integer YYYYMMDD, as the first four characters of
    its decimal text (the reference's exact rule).  For ordinary 8-digit
    values that is ``floor(x / 10000)``, computed without a string; only odd
    values (fewer or more digits, negative) take the text rule."""
    c = F.col(c) if isinstance(c, str) else c
    text_rule = F.substring(c.cast("string"), 1, 4).cast("int")
    return F.when(c.between(10_000_000, 99_999_999), F.floor(c / F.lit(10_000)).cast("int")).otherwise(text_rule)


def cos_degrees(degrees: Column) -> Column:
    """The cosine as ``haversine_miles`` takes it of a latitude."""
    return F.cos(degrees * F.lit(math.pi) / 180)


def haversine_miles(lat0, lon0, lat, lon, cos0: Column | None = None, cos: Column | None = None) -> Column:
    """Great-circle distance in miles.

    Same operation order as the reference's SQL so the doubles agree bit for
    bit: ``3959 * 2 * asin(sqrt(sin²(Δlat/2) + cos·cos·sin²(Δlon/2)))``.
    ``cos0`` and ``cos``: ``cos_degrees`` of the two latitudes, where rows hold them.
    """
    lat0, lon0 = as_column(lat0), as_column(lon0)
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    pi = F.lit(math.pi)
    dlat = F.sin((lat0 - lat) * pi / 180 / 2)
    dlon = F.sin((lon0 - lon) * pi / 180 / 2)
    cos0, cos = cos_degrees(lat0) if cos0 is None else cos0, cos_degrees(lat) if cos is None else cos
    inner = F.pow(dlat, 2) + cos0 * cos * F.pow(dlon, 2)
    return F.lit(EARTH_RADIUS_MILES * 2) * F.asin(F.sqrt(inner))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere; NaN without coordinates.  The product of two
    is the cosine of the angle between them."""
    lam = lon * F.lit(math.pi) / 180
    return [F.coalesce(c, F.lit(math.nan)) for c in (
        cos_degrees(lat) * F.cos(lam), cos_degrees(lat) * F.sin(lam), F.sin(lat * F.lit(math.pi) / 180))]


#: What two cosines of the same angle may differ by, however they are worked out: some
#: twenty times the rounding of ``unit_vector``, its product and ``haversine_miles``.
COSINE_MARGIN = 1e-14


def cosine_bounds(miles: Column) -> tuple[Column, Column]:
    """(``sure``, ``least``): a point whose cosine to another is at least ``sure`` lies within
    ``miles`` of it by ``haversine_miles``, one below ``least`` does not; between the
    two (millionths of a mile and less, but for radii of inches) the distance itself decides."""
    cosine = F.cos(F.least(miles / F.lit(float(EARTH_RADIUS_MILES)), F.lit(math.pi)))
    return F.when(miles >= 0, cosine + F.lit(COSINE_MARGIN)).otherwise(F.lit(2.0)), cosine - F.lit(COSINE_MARGIN)


def round_half_away(c, digits: int = 2) -> Column:
    """Round a double like the reference's engine: scale, round half away from
    zero on the binary value, unscale.  Spark's ``round`` rounds the decimal
    text instead (1.005 -> 1.01 where the reference gives 1.0)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def split_sic_text(text: Column) -> tuple[Column, Column]:
    """``"62012 - Software"`` -> (62012, "Software").

    Part 1 is cast with ``try_cast`` (failures become NULL); part 2 is the text
    between the first and second separator, empty when there is none.
    """
    code = F.split_part(text, F.lit(SIC_SEPARATOR), F.lit(1)).try_cast("int")
    description = F.split_part(text, F.lit(SIC_SEPARATOR), F.lit(2))
    return code, description


def latitude_box(lat0: float, radius_miles: float) -> tuple[float, float]:
    """Latitude band that contains every point within ``radius_miles``."""
    half = radius_miles / MILES_PER_DEGREE_LOWER + 1e-9
    return lat0 - half, lat0 + half


def longitude_half_width(lat0: float, radius_miles: float) -> float | None:
    """Half-width in degrees of longitude of a box covering the circle, or
    None when the circle reaches a pole (then no longitude bound is safe)."""
    lo, hi = latitude_box(lat0, radius_miles)
    edge = max(abs(lo), abs(hi))
    if edge >= 89.0:
        return None
    return radius_miles / (MILES_PER_DEGREE_LOWER * math.cos(math.radians(edge))) + 1e-9


def bounding_box(lat_col: Column, lon_col: Column, lat0: float, lon0: float, radius_miles: float) -> Column:
    """G5 helper: a coarse, always-covering box around the circle.

    Literal bounds on the raw lat / long columns reach the Parquet scan as
    pushed filters, so row groups outside the box are skipped.  The exact
    Haversine test still decides membership.
    """
    lo, hi = latitude_box(lat0, radius_miles)
    cond = lat_col.between(lo, hi)
    half = longitude_half_width(lat0, radius_miles)
    if half is not None and -180.0 <= lon0 - half and lon0 + half <= 180.0:
        cond = cond & lon_col.between(lon0 - half, lon0 + half)
    return cond
