"""Daily aggregation, time-series shaping and alignment of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.met import wind_from

def spine(df: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Every (key, day) between each key's first and last day."""
    span = df.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b")).alias(day))


def on_spine(df: DataFrame, key: str, day: str = "day") -> DataFrame:
    return spine(df, key, day).join(df, [key, day], "left")


def daily(df: DataFrame, key: str, ts: str, mean: list[str], top: list[str] = (), low: list[str] = (), total: list[str] = ()) -> DataFrame:
    """UTC-day means, maxima, minima and sums; days without rows appear, sums there are 0."""
    day = F.to_date(ts).alias("day")
    aggs = [F.avg(c).alias(f"{c}_mean") for c in mean] + [F.max(c).alias(f"{c}_max") for c in top]
    aggs += [F.min(c).alias(f"{c}_min") for c in low] + [F.sum(c).alias(f"{c}_sum") for c in total]
    out = on_spine(df.groupBy(key, day).agg(*aggs, F.count("*").alias("n_hours")), key)
    return out.withColumns({f"{c}_sum": F.coalesce(f"{c}_sum", F.lit(0.0)) for c in total} | {"n_hours": F.coalesce("n_hours", F.lit(0))})


def local_daily(df: DataFrame, key: str, ts: str, tz: str | Column, value: str, least: int = 18) -> DataFrame:
    """Local hours first, then local days with at least ``least`` hours."""
    local = F.from_utc_timestamp(ts, tz)
    hourly = df.groupBy(key, F.date_trunc("hour", local).alias("hour")).agg(F.avg(value).alias("v"))
    out = hourly.groupBy(key, F.to_date("hour").alias("day"))
    out = out.agg(F.avg("v").alias("mean"), F.max("v").alias("top"), F.min("v").alias("low"), F.count("v").alias("hours"))
    return out.where(F.col("hours") >= least)


def vector_daily(df: DataFrame, key: str, ts: str, u: str, v: str) -> DataFrame:
    """Mean speed of the hours and the direction of the mean vector."""
    speed = F.avg(F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v)))
    out = df.groupBy(key, F.to_date(ts).alias("day")).agg(speed.alias("wind"), F.avg(u).alias("_u"), F.avg(v).alias("_v"), F.count("*").alias("n_hours"))
    return out.withColumn("wdir", wind_from(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def priority_rain(df: DataFrame, key: str, day: str, code: str, value: str, codes: list[int]) -> DataFrame:
    """Total of the first code, in order of preference, whose total is not negative."""
    totals = df.groupBy(key, day, code).agg(F.sum(value).alias("t"), F.max(value).alias("m"))
    order = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(code))
    used = totals.where((order > 0) & (F.col("t") >= 0)).groupBy(key, day)
    return used.agg(F.min_by("t", order).alias("total"), F.min_by(code, order).alias("code"))


def gated(df: DataFrame, key: str, ts: str, value: str, least: int, early=(0, 8), late=(12, 18)) -> DataFrame:
    """Days of at least ``least`` rows; minimum only with an early reading, maximum only with a late one."""
    hour = F.hour(ts)
    out = df.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.bool_or(hour.between(*early)).alias("e"), F.bool_or(hour.between(*late)).alias("l"),
    )
    out = out.where(F.col("n") >= least)
    return out.select(key, "day", "n", "mean", F.when(F.col("e"), F.col("lo")).alias("tmin"), F.when(F.col("l"), F.col("hi")).alias("tmax"))


def hour_wide(df: DataFrame, key: str, ts: str, value: str, hours: list[int]) -> DataFrame:
    wide = df.groupBy(key, F.to_date(ts).alias("day"))
    cells = [F.avg(F.when(F.hour(ts) == h, F.col(value))).alias(f"{value}_{h:02d}") for h in hours]
    return wide.agg(*cells, F.max(value).alias("top"), F.min(value).alias("low"), F.count_distinct(F.hour(ts)).alias("n_hours"))


def fill(df: DataFrame, key: str, order: str, value: str, both: bool = True) -> DataFrame:
    """Forward fill, then (both) backward fill."""
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = F.last(value, ignorenulls=True).over(back)
    return df.withColumn(value, F.coalesce(filled, F.first(value, ignorenulls=True).over(ahead)) if both else filled)


def interpolate(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Linear by row position; leading gaps stay, trailing ones carry the last value."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    a = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumns({"_a": a, "_b": b})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    return out.withColumn(value, F.coalesce(F.col(value), line, F.col("_a.v"))).drop("_i", "_a", "_b")


def difference(df: DataFrame, keys: list[str], order: str, value: str, name: str, keep_first: bool = False) -> DataFrame:
    gap = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, F.coalesce(gap, F.col(value)) if keep_first else gap)


def rolling_max(df: DataFrame, key: str, order: str, value: str, rows: int, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.max(value).over(w))


def runs(df: DataFrame, key: str, day: str, length: int) -> DataFrame:
    """(key, start, end) of every window of ``length`` consecutive days."""
    w = Window.partitionBy(key).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    days = df.select(key, day).distinct().withColumn("island", island)
    place = F.row_number().over(Window.partitionBy(key, "island").orderBy(day))
    out = days.withColumn("p", place).where(F.col("p") >= length)
    return out.select(key, F.date_sub(F.col(day), length - 1).alias("start"), F.col(day).alias("end"))


def windows(df: DataFrame, key: str, day: str, value: str, length: int, stride: int, share: float, also: dict[str, int] | None = None) -> DataFrame:
    """Windows of a leap-free spine whose share of values is at least ``share``, with as many values of other columns as ``also`` asks."""
    full = on_spine(df, key, day).where(~((F.month(day) == 2) & (F.dayofmonth(day) == 29)))
    at = F.row_number().over(Window.partitionBy(key).orderBy(day)) - 1
    full = full.withColumn("_i", at)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - length + 1) / stride).cast("int"))
    full = full.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("_i") / stride).cast("int"))))
    out = full.groupBy(key, "win").agg(F.min(day).alias("start"), F.count("*").alias("n"), F.count(value).alias("valid"), *[F.count(c).alias(f"_n_{c}") for c in also or {}])
    enough = (F.col("n") == length) & (F.col("valid") >= share * length)
    for c, least in (also or {}).items():
        enough &= F.col(f"_n_{c}") >= least
    return out.where(enough).drop("n", *[f"_n_{c}" for c in also or {}])


def sequences(df: DataFrame, key: str, day: str, value: str, length: int) -> DataFrame:
    """The last ``length`` days' values at each end day where all are there and consecutive."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-(length - 1), 0)
    out = df.select(key, F.col(day).alias("end"), F.collect_list(value).over(w).alias("seq"), F.min(day).over(w).alias("a"))
    return out.where((F.size("seq") == length) & (F.datediff("end", "a") == length - 1)).drop("a")


def one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def slices(df: DataFrame, day: str, order: list[str]) -> DataFrame:
    """(day, start, stop) of each day in the day-sorted table, from counts of days."""
    counts = df.groupBy(day).agg(F.count("*").alias("n"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return counts.select(day, start.alias("start"), (start + F.col("n")).alias("stop"))


def smooth_year(df: DataFrame, keys: list[str], doy: str, value: str, sigma: float, cut: float = 4.0) -> DataFrame:
    """Circular Gaussian mean along a 365-day year, over the values that are there."""
    r = int(cut * sigma + 0.5)
    offsets = F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("o")
    rows = df.where(F.col(value).isNotNull()).select(*keys, doy, value, offsets)
    rows = rows.withColumn("w", F.exp(-0.5 * F.pow(F.col("o") / sigma, F.lit(2.0))))
    rows = rows.withColumn(doy, F.pmod(F.col(doy) + F.col("o") - 1, F.lit(365)) + 1)
    return rows.groupBy(*keys, doy).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def repeated_years(df: DataFrame, key: str, day: str, columns: list[str], reference: int, tolerance: float = 1e-9) -> DataFrame:
    """(key, year, days, repeated): how many days of a year repeat the reference year's."""
    base = df.where(F.year(day) == reference).select(key, F.dayofyear(day).alias("doy"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = df.withColumn("doy", F.dayofyear(day)).join(base, [key, "doy"], "left")
    same = F.lit(True)
    for c in columns:
        same &= F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull())
    return rows.groupBy(key, F.year(day).alias("year")).agg(F.count("*").alias("days"), F.sum(same.cast("int")).alias("repeated"))


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, bucket_s: int = 3600) -> DataFrame:
    """The right row of the same key nearest in time and within a bucket's length; earlier first.

    Times meet by hour buckets, the left side in three, so no key is gathered whole.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    a = left.withColumn("_s", F.explode(F.array(slot(lt) - 1, slot(lt), slot(lt) + 1)))
    b = right.withColumn("_s", slot(rt))
    gap = F.abs(F.unix_timestamp(lt) - F.unix_timestamp(rt))
    both = a.join(b, [key, "_s"]).withColumn("gap", gap).where(F.col("gap") <= bucket_s)
    pick = F.min(F.struct("gap", rt)).alias("m")
    return both.groupBy(key, lt).agg(pick).select(key, lt, F.col(f"m.{rt}").alias(rt), F.col("m.gap").alias("gap"))


def coalesced(df: DataFrame, others: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Fills nulls from other sources in their order of priority."""
    out = df
    for i, o in enumerate(others):
        out = out.join(o.select(*keys, F.col(value).alias(f"_{i}")), keys, "full_outer")
    return out.select(*keys, F.coalesce(F.col(value), *[F.col(f"_{i}") for i in range(len(others))]).alias(value))


def preferred_source(catalog: DataFrame, slot: list[str], primary: str, cutoff: str) -> DataFrame:
    """One path for each slot: the primary source up to the cutoff day, the other first after it."""
    first = (F.col("source") == primary) == (F.col("day") <= F.to_date(F.lit(cutoff)))
    return one_of_each(catalog, slot, [first.desc(), F.col("source")])
