"""Normalisation, scaling, calibration, innovations, splits and skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shuffled
from .quantiles import quantiles


def long_form(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, col, x): one row for each value, nulls too."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in columns]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.col", "p.x")


def norm_stats(df: DataFrame, columns: list[str], train: Column | None = None, population: bool = False, floor: float = 1e-8) -> DataFrame:
    """(col, mean, std) of training rows."""
    rows = df if train is None else df.where(train)
    std = F.stddev_pop("x") if population else F.stddev_samp("x")
    return long_form(rows, columns).groupBy("col").agg(F.avg("x").alias("mean"), F.greatest(std, F.lit(floor)).alias("std"))


def z_scored(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores; ``stats`` has one row a column and is turned into one row."""
    wide = stats.agg(*[F.max(F.when(F.col("col") == c, F.struct("mean", "std"))).alias(f"_{c}") for c in columns])
    out = df.join(F.broadcast(wide), F.lit(True))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_{c}.mean")) / F.col(f"_{c}.std") for c in columns}).drop(*[f"_{c}" for c in columns])


def min_max(df: DataFrame, columns: list[str], limits: dict[str, tuple[float, float]] | None = None, train: Column | None = None) -> DataFrame:
    """(col, bias, scale, n, invalid): scaler of training values inside their limits; scale 1 for a constant."""
    rows = long_form(df if train is None else df.where(train), columns)
    fine = F.lit(True)
    for c, (a, b) in (limits or {}).items():
        fine &= (F.col("col") != c) | F.col("x").between(a, b)
    good = F.when(fine, F.col("x"))
    out = rows.groupBy("col").agg(F.min(good).alias("bias"), F.max(good).alias("top"), F.count(good).alias("n"), F.count_if(F.col("x").isNotNull() & ~fine).alias("invalid"))
    span = F.col("top") - F.col("bias")
    return out.select("col", "bias", F.when(span == 0, F.lit(1.0)).otherwise(span).alias("scale"), "n", "invalid")


def scaled(x: Column, bias: Column, scale: Column) -> Column:
    return (x - bias) / scale + 5e-8


def unscaled(z: Column, bias: Column, scale: Column) -> Column:
    return (z - 5e-8) * scale + bias


def breakpoints(df: DataFrame, keys: list[str], a: str, b: str, levels: int = 201) -> DataFrame:
    """(keys, xs, ys, n): equal quantile levels of both sensors' matched values."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("x")) for s, c in (("a", a), ("b", b))]))
    long = rows.select(*keys, sides.alias("p")).select(*keys, F.col("p.side").alias("_side"), F.col("p.x").alias("_v"))
    found = quantiles(long, [*keys, "_side"], "_v", [i / (levels - 1) for i in range(levels)])
    of = lambda s: F.max(F.when(F.col("_side") == s, F.col("q")))
    return found.groupBy(*keys).agg(of("a").alias("xs"), of("b").alias("ys"), F.max("n").alias("n"))


def cross_calibrated(df: DataFrame, keys: list[str], x: str, y: str, reference: Column, name: str) -> DataFrame:
    """x moved to y's mean and spread, both from the reference rows of the group."""
    s = df.where(reference & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys)
    s = s.agg(F.avg(x).alias("_mx"), F.stddev_samp(x).alias("_sx"), F.avg(y).alias("_my"), F.stddev_samp(y).alias("_sy"))
    value = (F.col(x) - F.col("_mx")) * F.col("_sy") / F.nullif(F.col("_sx"), F.lit(0.0)) + F.col("_my")
    return df.join(s, keys, "left").withColumn(name, value).drop("_mx", "_sx", "_my", "_sy")


def innovations(table: DataFrame, edges: DataFrame, holdout: DataFrame, values: list[str]) -> DataFrame:
    """Mean, population deviation and number of the neighbours' residuals on the day.

    edges(src, dst): dst is a neighbour of src.  Holdout stations never feed another
    station.  Rows without a neighbour keep null statistics and the number 0.
    """
    sources = table.join(shuffled(holdout.select("fid").distinct()), "fid", "left_anti")
    sources = sources.select(F.col("fid").alias("dst"), "day", *[F.col(v).alias(f"_{v}") for v in values])
    met = edges.select("src", "dst").join(shuffled(sources), "dst").groupBy(F.col("src").alias("fid"), "day")
    aggs = []
    for v in values:
        aggs += [F.avg(f"_{v}").alias(f"inn_{v}_mean"), F.stddev_pop(f"_{v}").alias(f"inn_{v}_std"), F.count(f"_{v}").alias(f"inn_{v}_n")]
    out = table.join(shuffled(met.agg(*aggs)), ["fid", "day"], "left")
    return out.withColumns({f"inn_{v}_n": F.coalesce(f"inn_{v}_n", F.lit(0)) for v in values})


def skill(df: DataFrame, keys: list[str], obs: str, pred: str, least: int = 1) -> DataFrame:
    """bias, MAE, RMSE, R squared (null for constant observations) and n of each group."""
    rows = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull()).withColumn("_d", F.col(pred) - F.col(obs))
    rest = 1 - F.sum(F.col("_d") * F.col("_d")) / F.nullif(F.var_pop(obs) * F.count("*"), F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        F.avg("_d").alias("bias"), F.avg(F.abs("_d")).alias("mae"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        rest.alias("r2"), F.count("*").alias("n"),
    )
    return out.where(F.col("n") >= least)


def wind_skill(df: DataFrame, keys: list[str], par: str, perp: str, ppar: str, pperp: str) -> DataFrame:
    dp, dq = F.col(ppar) - F.col(par), F.col(pperp) - F.col(perp)
    base = F.sqrt(F.avg(F.col(par) * F.col(par) + F.col(perp) * F.col(perp)))
    rmse = F.sqrt(F.avg(dp * dp + dq * dq))
    return df.groupBy(*keys).agg(
        F.avg(F.abs(dp)).alias("par_mae"), F.avg(F.abs(dq)).alias("perp_mae"), rmse.alias("vector_rmse"),
        (100 * (1 - rmse / F.nullif(base, F.lit(0.0)))).alias("gain"),
    )


def huber(d: Column, delta: float) -> Column:
    a = F.abs(d)
    return F.when(a <= delta, 0.5 * d * d).otherwise(delta * (a - 0.5 * delta))


def calm_weight(speed: Column, theta: float, low: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), speed / theta))


def robust_scale(df: DataFrame, columns: list[str], train: Column, floor: float = 1e-6) -> DataFrame:
    """(col, scale): 1.4826 times the median absolute deviation of training rows."""
    rows = long_form(df.where(train), columns).where("x IS NOT NULL")
    mid = quantiles(rows, ["col"], "x", [0.5]).select("col", F.col("q")[0].alias("m"))
    off = rows.join(F.broadcast(mid), "col").select("col", F.abs(F.col("x") - F.col("m")).alias("d"))  # a row a column
    return quantiles(off, ["col"], "d", [0.5]).select("col", F.greatest(1.4826 * F.col("q")[0], F.lit(floor)).alias("scale"))


def diagnosis(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, raw, z, error): the 5th, 50th and 95th percentiles of each column and of its
    min-max scaled values, and the largest error of scaling there and back."""
    limits = min_max(df, columns).select("col", "bias", "scale")
    rows = long_form(df, columns).where("x IS NOT NULL").join(F.broadcast(limits), "col")  # a row a column
    rows = rows.withColumn("z", scaled(F.col("x"), F.col("bias"), F.col("scale")))
    error = F.max(F.abs(unscaled(F.col("z"), F.col("bias"), F.col("scale")) - F.col("x"))).alias("error")
    part = lambda c, name: quantiles(rows, ["col"], c, [0.05, 0.5, 0.95]).select("col", F.col("q").alias(name))
    return part("x", "raw").join(part("z", "z"), "col").join(rows.groupBy("col").agg(error), "col")


def mixed_hash(key: Column, seed: int) -> Column:
    """An arithmetic hash of an integer key that any SQL engine repeats."""
    return F.pmod(key * 7919 + seed, F.lit(100003))


def first_by_hash(df: DataFrame, groups: list[str], key: str, n: int | Column, seed: int) -> DataFrame:
    """n rows of each group in hash order, ties by key."""
    order = Window.partitionBy(*groups).orderBy(mixed_hash(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def station_split(stations: DataFrame, share: float, seed: int, key: str = "fid") -> DataFrame:
    """Adds split: exactly round(share * N) stations train, by hash order.

    The cut is the hash of that rank, found on the distribution of hashes, so stations
    are not sorted in one task.
    """
    rows = stations.withColumn("_h", mixed_hash(F.col(key), seed))
    buckets = rows.groupBy("_h").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)  # one row a hash value
    buckets = buckets.withColumn("upto", F.sum("n").over(upto))
    total = stations.count()
    want = F.lit(int(round(share * total)))
    inner = Window.partitionBy("_h").orderBy(key)
    rows = rows.withColumn("_r", F.row_number().over(inner)).join(buckets, "_h")
    train = F.col("upto") - F.col("n") + F.col("_r") <= want
    return rows.withColumn("split", F.when(train, "train").otherwise("val")).drop("_h", "_r", "n", "upto")


def strata_holdout(stations: DataFrame, value: str, share: float, seed: int, key: str = "fid") -> DataFrame:
    """A share of each quartile (right-closed, linear quantiles), one at least, in hash order.

    As in ``station_split``, the cut is a hash value, so no quartile is sorted in one task.
    """
    q = quantiles(stations, [], value, [0.25, 0.5, 0.75]).select("q")
    rows = stations.join(F.broadcast(q), F.lit(True))  # one row
    v = F.col(value)
    part = F.when(v <= F.col("q")[0], 0).when(v <= F.col("q")[1], 1).when(v <= F.col("q")[2], 2).when(v.isNotNull(), 3)
    rows = rows.withColumn("stratum", part).where("stratum IS NOT NULL").drop("q")
    rows = rows.withColumn("_h", mixed_hash(F.col(key), seed))
    whole = Window.partitionBy("stratum")
    buckets = rows.groupBy("stratum", "_h").agg(F.count("*").alias("_n"))  # at most a row a hash value
    want = F.greatest(F.lit(1), F.floor(F.sum("_n").over(whole) * share + 0.5))
    buckets = buckets.withColumns({"_want": want, "_before": F.sum("_n").over(whole.orderBy("_h")) - F.col("_n")})
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("stratum", "_h").orderBy(key)))
    rows = rows.join(buckets.where("_before < _want"), ["stratum", "_h"]).where("_before + _r <= _want")
    return rows.select(*stations.columns, "stratum")


def source_query_split(rows: DataFrame, holdout: DataFrame, share: float, seed: int, day: str = "day", key: str = "fid") -> DataFrame:
    """Adds role by day: of the stations that are not held out, round(share * n), from 1 to n - 1, are sources.

    Days with fewer than two such stations have no query; holdout stations have the role holdout.
    """
    held = holdout.select(key).distinct().withColumn("_held", F.lit(True))
    out = rows.join(held, key, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    order = Window.partitionBy(day, "_held").orderBy(mixed_hash(F.col(key) + F.unix_date(day) * 31, seed), key)
    n = F.count("*").over(Window.partitionBy(day, "_held"))
    want = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * share + 0.5)))
    out = out.withColumns({"_r": F.row_number().over(order), "_n": n, "_w": want})
    role = F.when(F.col("_held"), "holdout").when(F.col("_n") < 2, "source").when(F.col("_r") <= F.col("_w"), "source").otherwise("query")
    return out.withColumn("role", role).drop("_held", "_r", "_n", "_w")


def embedding_means(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element means of the vectors of each group, in order."""
    cells = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return cells.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias(vector))
