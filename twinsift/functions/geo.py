"""Coordinates, dates, seasons, zones, grids and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift import fixed_values as fv
from twinsift.functions import text as tx

EARTH_RADIUS_KM = 6371.0


def number_or_missing(text: Column) -> Column:
    """Number rounded to six decimals; unreadable text and zero count as missing."""
    value = tx.present(text).try_cast("double")     # a failing cast of blank text is slow
    return F.when((value != 0) & ~F.isnan(value), F.round(value, 6))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed decimal degrees; south and west are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def parse_date(text: Column) -> Column:
    """Date of the first of four layouts that fits: m/d/yyyy, yyyy-m-d, ISO with fraction, m/d/yy.

    Two-digit years from 69 on belong to the 1900s, the others to the 2000s.
    """
    s = tx.strip(text)
    us_long = F.when(s.rlike(r"\A\d{1,2}/\d{1,2}/\d{4}\z"), F.try_to_date(s, "M/d/yyyy"))
    iso = F.when(s.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_date(s, "yyyy-M-d"))
    stamp = F.when(
        s.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}T([01]?\d|2[0-3]):[0-5]?\d:([0-5]?\d|6[01])\.\d{1,6}Z\z"),
        F.try_to_date(F.substring_index(s, "T", 1), "yyyy-M-d"))
    short_year = F.regexp_extract(s, r"/(\d{2})\z", 1).try_cast("int")
    century = F.when(short_year >= 69, F.lit("19")).otherwise(F.lit("20"))
    widened = F.concat(F.regexp_extract(s, r"\A(\d{1,2}/\d{1,2}/)", 1), century,
                       F.regexp_extract(s, r"/(\d{2})\z", 1))
    us_short = F.when(s.rlike(r"\A\d{1,2}/\d{1,2}/\d{2}\z"), F.try_to_date(widened, "M/d/yyyy"))
    return F.coalesce(us_long, iso, stamp, us_short)


def season(month: Column, lat: Column) -> Column:
    """Meteorological season; south of the equator it is the opposite one."""
    quarter = F.floor((month % 12) / 3)
    shifted = F.when(F.coalesce(lat, F.lit(0.0)) < 0, (quarter + 2) % 4).otherwise(quarter)
    names = F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")])
    return F.when(month.between(1, 12), F.get(names, shifted.cast("int")))


def zone_attribute(lat: Column, lon: Column, attribute: int) -> Column:
    """Attribute of the first half-open latitude band that holds the point."""
    inside_lon = (lon >= fv.ZONE_LON_MIN) & (lon < fv.ZONE_LON_MAX)
    result = F.lit(None).cast("string")
    for band in reversed(fv.ZONE_BANDS):
        hit = (lat >= band[0]) & (lat < band[1]) & inside_lon
        result = F.when(hit, F.lit(band[attribute])).otherwise(result)
    return result


def zone_code(lat: Column, lon: Column) -> Column:
    return zone_attribute(lat, lon, 2)


def zone_climate(lat: Column, lon: Column) -> Column:
    return zone_attribute(lat, lon, 3)


def climate_vector(climate: Column) -> Column:
    """Six-part climate description; zeros for an unknown climate."""
    vectors = {k: F.array(*[F.lit(x) for x in v]) for k, v in fv.CLIMATE_VECTORS.items()}
    mapping = F.create_map(*[x for k, v in vectors.items() for x in (F.lit(k), v)])
    return F.coalesce(F.try_element_at(mapping, climate), F.array_repeat(F.lit(0.0), 6))


def month_phase(month: Column) -> Column:
    """(sin, cos) of the month on the year circle; zeros when the month is missing or wrong."""
    angle = month * F.lit(2.0 * math.pi / 12.0)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    return F.when(month.between(1, 12), F.array(F.sin(angle), F.cos(angle))).otherwise(zero)


def geo_time_vector(climate: Column, month: Column) -> Column:
    return F.concat(climate_vector(climate), month_phase(month))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; zero when a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / lengths)))


def cell_row(lat: Column, res: float) -> Column:
    """Grid row counted from the north edge."""
    return F.floor((F.lit(90.0) - lat) / F.lit(float(res))).cast("int")


def cell_col(lon: Column, res: float) -> Column:
    """Grid column counted from the antimeridian."""
    return F.floor((lon + F.lit(180.0)) / F.lit(float(res))).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.pow(F.sin((p2 - p1) / 2), F.lit(2))
    half_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    chord = half_lat + F.cos(p1) * F.cos(p2) * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray casting against a ring of (lat, lon) structs."""
    size = F.size(ring)

    def crosses(vertex: Column, index: Column) -> Column:
        other = F.get(ring, ((index + 1) % size).cast("int"))
        straddles = (vertex["lat"] > lat) != (other["lat"] > lat)
        run = (other["lon"] - vertex["lon"]) * (lat - vertex["lat"])
        # The division is only reached where the edge straddles the ray, so it is never by zero.
        at = F.when(straddles, run / (other["lat"] - vertex["lat"]) + vertex["lon"])
        return F.when(straddles & (lon < at), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.transform(ring, crosses), F.lit(0), lambda acc, x: acc + x)
    return hits % 2 == 1
