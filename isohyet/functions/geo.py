"""Distances, bearings, grid geometry, seasons, units, text and array helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
    b = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    h = a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), h))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 1 to 2, radians in (-pi, pi]."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))


def bearing_degrees(*points: Column) -> Column:
    turned = F.degrees(bearing(*points))
    return F.when(turned < 0, turned + 360).otherwise(turned)


def upwind(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """Cosine and sine of the wind's origin against a bearing."""
    origin = F.atan2(-u, -v) - angle
    return F.cos(origin), F.sin(origin)


def facet_alignment(s1: Column, c1: Column, s2: Column, c2: Column) -> Column:
    """Cosine between two facing vectors; 0 where one is flat."""
    size = F.sqrt(s1 * s1 + c1 * c1) * F.sqrt(s2 * s2 + c2 * c2)
    return F.when(size > 1e-8, (s1 * s2 + c1 * c2) / size).otherwise(F.lit(0.0))


def season(day: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.dayofyear(day) / 365.25
    return F.sin(angle), F.cos(angle)


def doy365(day: Column) -> Column:
    """Day of a 365-day year; 29 February counts as 1 March."""
    past = (F.dayofmonth(F.last_day(F.make_date(F.year(day), F.lit(2), F.lit(1)))) == 29) & (F.dayofyear(day) > 60)
    return F.dayofyear(day) - past.cast("int")


def period(day: Column, rule: str = "calendar") -> Column:
    """Season 0 to 4 under one of three rules."""
    if rule == "doy":
        n, parts = F.dayofyear(day), (60, 121, 196, 273)
        return sum(((n >= p).cast("int") for p in parts[1:]), (n >= parts[0]).cast("int"))
    code = F.month(day) * 100 + F.dayofmonth(day)
    bounds = {"calendar": (301, 501, 715, 930), "start": (301, 501, 715, 930)}[rule]
    late = 930 if rule == "start" else 930
    out = F.when(code < bounds[0], 0).when(code < bounds[1], 1).when(code < bounds[2], 2)
    return out.when(code < late, 3).otherwise(4)


def cell(x: Column, origin: float, size: float, rule: str = "truncate") -> Column:
    """Index of a coordinate on a regular axis: truncate, floor or half-even from centres."""
    at = (x - origin) / size
    return {"truncate": at.cast("int"), "floor": F.floor(at).cast("int"), "centre": F.bround(at, 0).cast("int")}[rule]


def centre(index: Column, origin: float, size: float) -> Column:
    return origin + (index + 0.5) * size


def quadrants(w: float, s: float, e: float, n: float) -> list[tuple[float, float, float, float]]:
    x, y = (w + e) / 2, (s + n) / 2
    return [(w, s, x, y), (x, s, e, y), (w, y, x, n), (x, y, e, n)]


def aspect_class(aspect: Column) -> Column:
    """0 for flat (negative), else 1 to 8 clockwise from north."""
    turned = F.floor(((aspect + 22.5) % 360) / 45).cast("int") + 1
    return F.when(aspect < 0, F.lit(0)).otherwise(turned)


def class_vector(kind: Column) -> tuple[Column, Column]:
    angle = F.radians((kind - 1) * 45.0)
    flat = kind == 0
    return F.when(flat, F.lit(0.0)).otherwise(F.sin(angle)), F.when(flat, F.lit(0.0)).otherwise(F.cos(angle))


def ramp(height: Column, low: float = 75.0, high: float = 250.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (height - low) / (high - low)))


def at_direction(bins: Column, n: int, degrees: Column) -> Column:
    """Value of n equally spaced bins at a direction, between its two neighbours."""
    at = (degrees % 360) / (360.0 / n)
    low = F.floor(at).cast("int")
    a, b = F.get(bins, low % n), F.get(bins, (low + 1) % n)
    return a + (b - a) * (at - low)


#: Unit -> (factor, offset) of the value in the target unit.
UNITS = {
    "k_to_c": (1.0, -273.15),
    "f_to_c": (5.0 / 9.0, -160.0 / 9.0),
    "pa_to_kpa": (0.001, 0.0),
    "hpa_to_kpa": (0.1, 0.0),
    "w_to_mj_hour": (0.0036, 0.0),
    "w_to_mj_day": (0.0864, 0.0),
    "ft_to_m": (0.3048, 0.0),
    "in_to_mm": (25.4, 0.0),
    "tenths": (0.1, 0.0),
    "hundredths": (0.01, 0.0),
}


def convert(value: Column, unit: str) -> Column:
    factor, offset = UNITS[unit]
    return value * factor + offset


def band(value: Column, scale: float = 1e-4) -> Column:
    """Scaled band value: 0 is missing, negatives are 0."""
    return F.when(value != 0, F.greatest(F.lit(0.0), value * scale))


def station_id(name: Column, size: int = 10) -> Column:
    return F.upper(F.substring(F.regexp_replace(F.trim(name), r"\W+", "_"), 1, size))


def dms(text: Column) -> Column:
    """``12°30'36"W`` as a signed decimal; null for other text."""
    pattern = r"""^\s*(\d+)\D+(\d+)\D+(\d+(?:\.\d+)?)\D*?([NSEW])\s*$"""
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    sign = F.when(F.regexp_extract(text, pattern, 4).isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * (part(1) + part(2) / 60 + part(3) / 3600)


def quantile_map(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear map through (xs, ys), flat beyond both ends; no map: unchanged."""
    above = F.size(F.filter(xs, lambda v: v <= x))
    n = F.size(xs)
    x0, x1 = F.get(xs, above - 1), F.get(xs, above)
    y0, y1 = F.get(ys, above - 1), F.get(ys, above)
    inside = y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0))
    mapped = F.when(above == 0, F.get(ys, F.lit(0))).when(above >= n, F.get(ys, n - 1)).otherwise(inside)
    return F.when(xs.isNull() | x.isNull() | (n == 0), x).otherwise(mapped)


def array_gap(a: Column, b: Column) -> Column:
    """Element by element a - b."""
    return F.zip_with(a, b, lambda p, q: p - q)


def array_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x.cast("double")))
