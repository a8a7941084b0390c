"""Harmonic station climatologies, ridge on terrain, surfaces, linear probes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import shuffled
from .spatial import idw


def basis(doy: Column, cycles: int = 2) -> list[Column]:
    angle = lambda k: 2 * math.pi * k * doy / 365.0
    return [F.lit(1.0)] + [f(angle(k)) for k in range(1, cycles + 1) for f in (F.sin, F.cos)]


def harmonics(df: DataFrame, key: str, doy: str, value: str, cycles: int = 2) -> DataFrame:
    """(key, coef array, r2, n) by least squares; groups with no more points than coefficients drop out.

    The Gram sums are one aggregate; each group's small system is solved in a vectorised
    function over rows of sums, whatever the number of its points.
    """
    x = basis(F.col(doy), cycles)
    m = len(x)
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(m)]
    facts = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *sums)

    def solve(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                gram = np.empty((m, m))
                for i in range(m):
                    for j in range(i, m):
                        gram[i, j] = gram[j, i] = getattr(r, f"g{i}_{j}")
                right = np.array([getattr(r, f"b{i}") for i in range(m)])
                coef = np.linalg.lstsq(gram, right, rcond=None)[0]
                rest = r.syy - 2 * coef @ right + coef @ gram @ coef
                spread = r.syy - r.sy * r.sy / r.n
                out.append((getattr(r, key), coef.tolist(), 1 - rest / spread if spread > 0 else None, r.n))
            yield pd.DataFrame(out, columns=[key, "coef", "r2", "n"])

    kind = dict(df.dtypes)[key]
    return facts.where(F.col("n") > m).mapInPandas(solve, f"{key} {kind}, coef array<double>, r2 double, n long")


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> np.ndarray:
    """Intercept and weights of a ridge fit with a free intercept; sums are aggregated on the cluster."""
    f = [F.lit(1.0)] + [F.col(c) for c in features]
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(f)], F.col(target).cast("double").alias("y")).dropna()
    m = len(f)
    got = rows.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(m) for j in range(m)], *[F.sum(F.col(f"x{i}") * F.col("y")) for i in range(m)]).first()
    gram, right = np.array(got[: m * m], float).reshape(m, m), np.array(got[m * m :], float)
    weight = alpha * np.eye(m)
    weight[0, 0] = 0
    return np.linalg.solve(gram + weight, right)


def terrain_features(df: DataFrame) -> DataFrame:
    z, lat = F.col("elev") / 1000, F.col("lat")
    return df.withColumns({"z": z, "z2": z * z, "latz": lat * z})


def surface(stations: DataFrame, cells: DataFrame, coefficient: str, r_km: float = 150.0, k: int = 20, alpha: float = 1.0) -> DataFrame:
    """One coefficient on cells(fid, lat, lon, elev): ridge on terrain plus the residuals' inverse-distance mean."""
    names = ["z", "z2", "lat", "lon", "latz"]
    s = terrain_features(stations)
    w = ridge(s, names, coefficient, alpha)
    line = lambda: sum((F.col(c) * float(x) for c, x in zip(names, w[1:], strict=True)), F.lit(float(w[0])))
    rest = s.withColumn("rest", F.col(coefficient) - line()).select("fid", "lat", "lon", "rest")
    out = terrain_features(cells).withColumn("line", line())
    near = idw(rest, cells, "rest", r_km, k)
    return out.join(shuffled(near.select("fid", "rest")), "fid", "left").withColumn(coefficient, F.col("line") + F.coalesce("rest", F.lit(0.0))).drop("line", "rest", "z", "z2", "latz")


def evaluated(coef: DataFrame, key: str, cycles: int = 2) -> DataFrame:
    """(key, doy, value) of all 365 days from coefficient arrays."""
    days = coef.select(key, "coef", F.explode(F.sequence(F.lit(1), F.lit(365))).alias("doy"))
    value = sum((F.col("coef")[i] * x for i, x in enumerate(basis(F.col("doy"), cycles))), F.lit(0.0))
    return days.select(key, "doy", value.alias("value"))


def evaluated_at(rows: DataFrame, coef: DataFrame, key: str, doy: str, cycles: int = 2) -> DataFrame:
    """Rows of days 1 to 365 with their key's value on that day, from coefficient arrays; others drop out."""
    value = sum((F.col("coef")[i] * x for i, x in enumerate(basis(F.col(doy), cycles))), F.lit(0.0))
    met = rows.where(F.col(doy).between(1, 365)).join(shuffled(coef.select(key, "coef")), key)
    return met.withColumn("value", value).drop("coef")


def line(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """(keys, intercept, slope, n) of the least-squares line, over rows with both values; null where x does not vary."""
    return df.groupBy(*keys).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_count(y, x).alias("n"))
