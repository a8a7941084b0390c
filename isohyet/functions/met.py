"""Humidity, wind, stability and radiation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the two vapour-pressure curves (kPa, degrees C).
TETENS = (0.6108, 17.27, 237.3)
MAGNUS = (0.61094, 17.625, 243.04)
#: Stability bounds.
GRAVITY, LEAST_ROUGHNESS, LEAST_WIND, FACTOR_RANGE = 9.81, 0.001, 0.1, (0.5, 3.0)


def vapour_pressure(t: Column, curve: tuple[float, float, float] = TETENS) -> Column:
    """Saturation pressure at t; at the dew point, actual vapour pressure."""
    a, b, c = curve
    return a * F.exp(b * t / (t + c))


def dew_point(ea: Column, curve: tuple[float, float, float] = TETENS) -> Column:
    a, b, c = curve
    y = F.log(F.when(ea > 0, ea) / a)
    return c * y / (b - y)


def ea_from_q(q: Column, p: Column) -> Column:
    """Vapour pressure from specific humidity; null for a zero denominator."""
    return q * p / F.nullif(0.622 + 0.378 * q, F.lit(0.0))


def q_from_ea(ea: Column, p: Column) -> Column:
    return 0.622 * ea / F.nullif(p - 0.378 * ea, F.lit(0.0))


def ea_from_rh_range(rhmax: Column, rhmin: Column, tmax: Column, tmin: Column) -> Column:
    return (vapour_pressure(tmin) * rhmax / 100 + vapour_pressure(tmax) * rhmin / 100) / 2


def ea_from_rh(rh: Column, t: Column) -> Column:
    return vapour_pressure(t) * rh / 100


def compiled_ea(ea, tdew, rhmax, rhmin, rhavg, tmax, tmin, k0) -> Column:
    """The first available: ea, dew point, RH range, mean RH, tmin less k0."""
    return F.coalesce(
        ea,
        vapour_pressure(tdew),
        ea_from_rh_range(rhmax, rhmin, tmax, tmin),
        ea_from_rh(rhavg, (tmax + tmin) / 2),
        vapour_pressure(tmin - k0),
    )


def air_pressure(elev: Column, method: str = "asce") -> Column:
    exponent = {"asce": 5.26, "refet": 9.8 / (0.0065 * 286.9)}[method]
    return 101.3 * F.pow((293.0 - 0.0065 * elev) / 293.0, F.lit(exponent))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from(u: Column, v: Column) -> Column:
    """Direction that the wind comes from, degrees in [0, 360); without wind that of the signed zeros.

    Spark's atan2 takes -0.0 as 0.0; SQL and numpy do not, so that u = v = 0.0 is 180 there.
    """
    calm = F.when(v.cast("double").cast("string") == "0.0", F.lit(180.0)).otherwise(F.lit(0.0))
    return F.when((u == 0) & (v == 0), calm).otherwise(_turn(F.degrees(F.atan2(-u, -v))))


def wind_uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    angle = F.radians(direction)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def _turn(degrees: Column) -> Column:
    turned = degrees % 360
    return F.when(turned < 0, turned + 360).otherwise(turned)


def wind_residuals(u, v, bu, bv, least: float = 1e-6) -> tuple[Column, Column]:
    """Residual wind along and across the baseline wind."""
    speed = F.greatest(wind_speed(bu, bv), F.lit(least))
    du, dv = u - bu, v - bv
    return (du * bu + dv * bv) / speed, (dv * bu - du * bv) / speed


def wind_from_residuals(par, perp, bu, bv, least: float = 1e-6) -> tuple[Column, Column]:
    speed = F.greatest(wind_speed(bu, bv), F.lit(least))
    return bu + (par * bu - perp * bv) / speed, bv + (par * bv + perp * bu) / speed


def neutral_factor(z: Column) -> Column:
    """Log-law factor from height z to 10 m; 1 at 0.2 m and below or at 10 m."""
    use = (z > 0.2) & (z != 10)
    return F.when(use, math.log(67.8 * 10 - 5.42) / F.log(67.8 * z - 5.42)).otherwise(F.lit(1.0))


def to_two_metres(speed: Column, z: Column) -> Column:
    return speed * 4.87 / F.log(67.8 * z - 5.42)


def richardson(t2: Column, skin: Column, u: Column, z: float = 10.0) -> Column:
    wind = F.greatest(u, F.lit(LEAST_WIND))
    return GRAVITY * z * (t2 - skin) / (0.5 * (t2 + skin) * wind * wind)


def obukhov(ri: Column, z: float = 10.0) -> Column:
    capped = F.least(ri, F.lit(0.19))
    return z / F.when(F.abs(capped) < 1e-6, F.lit(1e-6)).otherwise(capped)


def psi_m(zeta: Column) -> Column:
    x = F.pow(1 - 16 * F.least(zeta, F.lit(0.0)), F.lit(0.25))
    unstable = 2 * F.log((1 + x) / 2) + F.log((1 + x * x) / 2) - 2 * F.atan(x) + math.pi / 2
    return F.when(zeta > 0, -5 * F.least(zeta, F.lit(1.0))).when(zeta < 0, unstable).otherwise(F.lit(0.0))


def stability_factor(t2: Column, skin: Column, u: Column, z0: Column, zw: Column) -> Column:
    """Factor that takes wind from height zw to 10 m under the air's stability."""
    rough, length = F.greatest(z0, F.lit(LEAST_ROUGHNESS)), obukhov(richardson(t2, skin, u))
    top = F.log(10 / rough) - psi_m(10 / length)
    below = F.log(zw / rough) - psi_m(zw / length)
    below = F.when(F.abs(below) < 0.01, F.lit(0.01)).otherwise(below)
    factor = F.greatest(F.lit(FACTOR_RANGE[0]), F.least(F.lit(FACTOR_RANGE[1]), top / below))
    return F.when(F.abs(zw - 10) < 0.1, F.lit(1.0)).otherwise(factor)


def extraterrestrial(lat: Column, doy: Column) -> Column:
    """Ra in MJ per square metre and day."""
    phi, day = F.radians(lat), 2 * math.pi / 365 * doy
    tilt = 0.409 * F.sin(day - 1.39)
    cos_sunset = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(tilt)))
    sunset = F.acos(cos_sunset)
    shape = sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset)
    return F.greatest(F.lit(0.0), 24 * 60 / math.pi * 0.0820 * (1 + 0.033 * F.cos(day)) * shape)


def cloud_radiation(cloud: Column, lat: Column, doy: Column) -> Column:
    """Mean solar radiation (W per square metre) under cloud cover in percent."""
    sun = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -0.0083 * cloud + 0.9659))
    return (0.25 + 0.50 * sun) * extraterrestrial(lat, doy) / 0.0864


def clear_sky(ra: Column) -> Column:
    return 0.75 * ra


def range_radiation(rso, spread, month_spread, b=(0.031, 0.201, -0.185)) -> Column:
    """Radiation from the daily temperature range against its monthly mean."""
    shape = b[0] + b[1] * F.exp(b[2] * month_spread)
    return rso * (1 - 0.9 * F.exp(-shape * F.pow(spread, F.lit(1.5))))


def reference_et(tmax, tmin, ea, rs, u2, elev, lat, doy) -> Column:
    """ASCE standardised short-reference evapotranspiration, mm a day (rs in MJ)."""
    mean = (tmax + tmin) / 2
    es = (vapour_pressure(tmax) + vapour_pressure(tmin)) / 2
    slope = 4098 * vapour_pressure(mean) / F.pow(mean + 237.3, F.lit(2.0))
    gamma = 0.000665 * air_pressure(elev)
    rso = F.nullif((0.75 + 2e-5 * elev) * extraterrestrial(lat, doy), F.lit(0.0))
    cloud = 1.35 * F.greatest(F.lit(0.3), F.least(F.lit(1.0), rs / rso)) - 0.35
    fourth = (F.pow(tmax + 273.16, F.lit(4.0)) + F.pow(tmin + 273.16, F.lit(4.0))) / 2
    net = 0.77 * rs - 4.901e-9 * cloud * (0.34 - 0.14 * F.sqrt(F.greatest(ea, F.lit(0.0)))) * fourth
    top = 0.408 * slope * net + gamma * 900 / (mean + 273) * u2 * (es - ea)
    return top / (slope + gamma * (1 + 0.34 * u2))
