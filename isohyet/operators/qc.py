"""Scanning and quality control."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import one_row, quantiles
from .stats import long_form

#: Rejecting bits and accepted flags of hourly observations.
REJECT_BITS = 115
GOOD_FLAGS = ("V", "S", "C", "G")
#: Name parts that carry the humidity answer.
LEAKS = ("spfh_", "dpt_", "rh_", "q_", "sh_", "dew")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as null."""
    bad = lambda c: F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    kinds = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if c in kinds else F.col(c) for c in df.columns])


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of some column names that a frame has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def inside(df: DataFrame, w: float, s: float, e: float, n: float, closed: bool = False, lat="lat", lon="lon") -> DataFrame:
    """Rows in a box; half open unless closed."""
    y, x = F.col(lat), F.col(lon)
    upper = (y <= n) & (x <= e) if closed else (y < n) & (x < e)
    return df.where((y >= s) & (x >= w) & upper)


def checked(value: Column, flag: Column, bits: Column, low: float, high: float, good=GOOD_FLAGS, mask: int = REJECT_BITS) -> Column:
    """The value where its flag, its bits and its bounds pass, else null."""
    passed = flag.isin(*good) & (F.coalesce(bits, F.lit(0)).bitwiseAND(F.lit(mask)) == 0) & value.between(low, high)
    return F.when(passed, value)


def without_leaks(df: DataFrame, safe: Iterable[str] = ()) -> DataFrame:
    """Without columns whose name gives away the humidity."""
    kept = set(safe)
    return df.select(*[c for c in df.columns if c in kept or not any(x in c.lower() for x in LEAKS)])


def with_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=targets)


def assert_baseline(df: DataFrame, residual: str, source: str, allowed: Iterable[str]) -> DataFrame:
    """Raises at run time where a row with a residual names another baseline."""
    fine = F.col(residual).isNull() | F.coalesce(F.col(source).isin(*allowed), F.lit(False))
    passed = F.assert_true(fine, F.lit(f"{residual}: its baseline is not among the allowed ones"))
    return df.withColumn(residual, F.when(passed.isNull(), F.col(residual)))


def limited(df: DataFrame, limits: Mapping[str, tuple[float, float] | None]) -> DataFrame:
    """Values out of their limits as null; a limit of None leaves a column alone."""
    return df.withColumns({c: F.when(F.col(c).between(*b), F.col(c)) for c, b in limits.items() if b and c in df.columns})


def flagged(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Adds ``{c}_miss`` (1: null); absent columns are added as null."""
    out = df
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.withColumns({f"{c}_miss": F.col(c).isNull().cast("int") for c in columns})


def rejected(df: DataFrame, rejects: DataFrame, key: str = "fid") -> DataFrame:
    return df.join(rejects.select(key).distinct(), key, "left_anti")


def accepted(df: DataFrame, providers: list[str], stations: DataFrame, bins: DataFrame, rejects: DataFrame) -> DataFrame:
    """Stations by provider or either list, but not rejected ones; ``path`` says why."""
    provider = F.substring(F.coalesce("provider", F.lit("UNKNOWN")), 1, 8)
    mark = lambda d, c: d.select("fid").distinct().withColumn(c, F.lit(True))
    out = df.join(mark(stations, "s"), "fid", "left").join(mark(bins, "b"), "fid", "left").join(mark(rejects, "r"), "fid", "left")
    path = F.when(provider.isin(*providers), "provider").when(F.col("s"), "station").when(F.col("b"), "bin")
    return out.withColumn("path", path).where(F.col("path").isNotNull() & F.col("r").isNull()).drop("s", "b", "r")


def winsorised(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values pulled to the table's exact quantiles; nulls stay."""
    edges = one_row(long_form(df, columns), columns, [low, high])
    out = df.join(F.broadcast(edges), F.lit(True))  # one row
    cut = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1]))
    return out.withColumns({c: cut(c) for c in columns}).drop(*[f"_{c}" for c in columns])


def filled_by_train_median(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Nulls as the median of training rows, 0 if there is none."""
    middle = one_row(long_form(df.where(train), columns), columns, [0.5])
    out = df.join(F.broadcast(middle), F.lit(True))  # one row
    return out.withColumns({c: F.coalesce(F.col(c), F.get(f"_{c}", F.lit(0)), F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def unit_facts(df: DataFrame, key: str, column: str) -> DataFrame:
    """Median, maximum and 99th percentile of each group, by which units are guessed."""
    got = quantiles(df, [key], column, [0.5, 0.99, 1.0])
    return got.select(key, F.col("q")[0].alias("med"), F.col("q")[2].alias("top"), F.col("q")[1].alias("p99"))


def guessed_unit(kind: str) -> Column:
    """Name of the conversion that the facts of ``unit_facts`` ask for."""
    med, top, p99 = F.col("med"), F.col("top"), F.col("p99")
    return {
        "temperature": F.when(med > 200, "k_to_c"),
        "pressure": F.when(med > 20000, "pa_to_kpa").when(med.between(500, 1500), "hpa_to_kpa"),
        "humidity": F.when(top <= 1.5, "fraction"),
        "direction": F.when(top <= 7, "radians"),
        "mixing": F.when(med > 0.2, "g_per_kg"),
        "rain": F.when(p99 > 500, "hundredths"),
    }[kind]


def modified_z(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Adds z = 0.6745 (x - median) / MAD of the group; null where the MAD is 0."""
    group = F.struct(*keys)
    middle = quantiles(df, keys, column, [0.5]).select(group.alias("_k"), F.col("q")[0].alias("_m"))
    off = df.withColumn("_k", group).join(middle, "_k", "left").withColumn("_a", F.abs(F.col(column) - F.col("_m")))
    spread = quantiles(off.select(*keys, "_a"), keys, "_a", [0.5]).select(group.alias("_k"), F.col("q")[0].alias("_d"))
    out = off.drop("_a").join(spread, "_k", "left")
    return out.withColumn("z", 0.6745 * (F.col(column) - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))).drop("_m", "_d", "_k")


def isolated(df: DataFrame, key: str, order: Column, column: str, reach: int) -> DataFrame:
    """Values alone within ``reach`` units of ``order`` become null."""
    near = Window.partitionBy(key).orderBy(order).rangeBetween(-reach, reach)
    return df.withColumn(column, F.when(F.count(column).over(near) > 1, F.col(column)))


def rejection_monitor(df: DataFrame, days: int = 90, limit: float = 0.5) -> DataFrame:
    """(fid, day, n, bad): adds the trailing rejection rate and whether it is over the limit."""
    at = F.unix_date("day")
    w = Window.partitionBy("fid").orderBy(at).rangeBetween(-(days - 1), 0)
    rate = F.sum("bad").over(w) / F.nullif(F.sum("n").over(w), F.lit(0))
    return df.withColumn("rate", rate).withColumn("listed", F.coalesce(F.col("rate") > limit, F.lit(False)))
