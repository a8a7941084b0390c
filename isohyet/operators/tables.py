"""Station-day tables: canonical columns, checks, chained joins, daily summaries, graph nodes."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import met
from ..shared import shuffled
from .qc import first_present
from .quantiles import quantiles
from .stats import mixed_hash


def feature_columns(columns: list[str], product: str, sx: bool = True) -> list[str]:
    """Weather columns of a product, sorted, without residuals; then the shelter columns of 2 and 10 km."""
    weather = sorted(c for c in columns if c.endswith(f"_{product}") and not c.startswith("delta_"))
    return weather + (sorted(c for c in columns if re.fullmatch(r"sx_.*_(2|10)k", c)) if sx else [])


def canonical(df: DataFrame, aliases: Mapping[str, list[str]], product: str) -> DataFrame:
    """The first present alias of each variable as ``{variable}_{product}``; wind and vapour pressure derived where absent."""
    found = {v: n for v, names in aliases.items() if (n := first_present(df, names))}
    made = {v: F.col(n) for v, n in found.items()}
    if "wind" not in made and {"u", "v"} <= made.keys():
        made |= {"wind": met.wind_speed(made["u"], made["v"]), "wdir": met.wind_from(made["u"], made["v"])}
    if "ea" not in made and {"q", "p"} <= made.keys():
        made["ea"] = met.ea_from_q(made["q"], made["p"])
    rest = [c for c in df.columns if c not in found.values()]
    return df.select(*rest, *[c.alias(f"{v}_{product}") for v, c in made.items()])


def parsed_times(df: DataFrame, column: str) -> DataFrame:
    """``column`` as a timestamp, also from yyyyMMddHH; rows that neither reads are dropped."""
    at = F.coalesce(F.try_to_timestamp(column), F.try_to_timestamp(F.col(column), F.lit("yyyyMMddHH")))
    return df.withColumn(column, at).where(F.col(column).isNotNull())


def without_void(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that are all 0 or null at a station become null there; rows without any value go."""
    void = df.groupBy(key).agg(*[(F.max(F.abs(F.coalesce(c, F.lit(0.0)))) == 0).alias(f"_{c}") for c in columns])
    out = df.join(void, key)
    return out.select(*[F.when(~F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]).dropna("all", subset=columns)


def contract(df: DataFrame, vector: str, key: str, attributes: DataFrame, names: list[str]) -> DataFrame:
    """(rule, bad): lengths of vectors beyond one, rows without a vector, keys without attributes, names that are missing."""
    lengths = df.agg((F.count_distinct(F.size(vector)) - 1).alias("bad")).select(F.lit("lengths").alias("rule"), "bad")
    empty = df.agg(F.count(F.when(F.col(vector).isNull(), 1)).alias("bad")).select(F.lit("vectors").alias("rule"), "bad")
    lost = df.join(attributes, key, "left_anti").agg(F.count_distinct(key).alias("bad")).select(F.lit("attributes").alias("rule"), "bad")
    missing = df.limit(0).agg((F.count("*") + len(set(names) - set(df.columns))).alias("bad")).select(F.lit("names").alias("rule"), "bad")
    return lengths.unionByName(empty).unionByName(lost).unionByName(missing)


def supervised(df: DataFrame, required: str, targets: list[str], most: float) -> DataFrame:
    """Rows with the required column; each target with a flag ``{target}_ok``, and 0 where that is false."""
    out = df.where(F.col(required).isNotNull())
    good = lambda c: F.coalesce(F.abs(F.col(c)) <= most, F.lit(False)) & ~F.isnan(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    out = out.withColumns({f"{c}_ok": good(c) for c in targets})
    return out.withColumns({c: F.when(F.col(f"{c}_ok"), F.col(c)).otherwise(F.lit(0.0)) for c in targets})


def chained(df: DataFrame, others: Mapping[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of products on the same keys; their columns end in the product's name."""
    for name, other in others.items():
        renamed = other.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in other.columns if c not in keys])
        df = df.join(renamed, keys, "left")
    return df


def with_family(df: DataFrame, family: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that replaces the columns that an earlier run has added."""
    return df.drop(*[c for c in family.columns if c not in keys]).join(family, keys, "left")


def with_static(df: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """The same for attributes of stations, which must be unique, so that no row is added."""
    twice = static.groupBy(key).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"{key} {twice[0][key]} has several rows of attributes")
    return with_family(df, static, [key])


def misaligned(values: DataFrame, df: DataFrame, key: str, day: str) -> DataFrame:
    """Stations of ``values`` none of whose days are days of the table."""
    return values.select(key).distinct().join(values.select(key, day).join(df.select(key, day), [key, day]).select(key).distinct(), key, "left_anti")


def aligned(obs: DataFrame, products: DataFrame, names: list[str], kelvin: tuple[str, ...] = ()) -> DataFrame:
    """Observed days, by left join, with a column for each product, also for one that has no rows."""
    wide = products.groupBy("fid", "day").pivot("product", names).agg(F.avg("value"))
    wide = wide.withColumns({c: F.col(c) - 273.15 for c in kelvin})
    return obs.where(F.col("obs").isNotNull()).join(wide, ["fid", "day"], "left")


def compared(obs: DataFrame, predicted: DataFrame, least: int = 2) -> DataFrame:
    """(fid, source, n, bias, mae) over days on which both are present."""
    both = obs.select("fid", "day", "obs").join(predicted.select("fid", "day", "source", "pred"), ["fid", "day"]).dropna()
    gap = F.col("pred") - F.col("obs")
    out = both.groupBy("fid", "source").agg(F.count("*").alias("n"), F.avg(gap).alias("bias"), F.avg(F.abs(gap)).alias("mae"))
    return out.where(F.col("n") >= least)


def height_factor(z: Column, day_factor: Column) -> Column:
    """The day's factor to 10 m, else the neutral one; 1 at 10 m and for sensors at 0.2 m or below."""
    return F.when((z != 10) & (z > 0.2), F.coalesce(day_factor, met.neutral_factor(z))).otherwise(F.lit(1.0))


def by_doy(df: DataFrame, lookup: DataFrame, key: str, day: str) -> DataFrame:
    """A lookup by station and day of year; 31 December of leap years uses day 365."""
    return df.withColumn("doy", F.least(F.dayofyear(day), F.lit(365))).join(lookup, [key, "doy"], "left")


def at_cells(points: DataFrame, cells: DataFrame, row: Column, col: Column, shape: tuple[int, int], outside: str = "drop") -> DataFrame:
    """Points with the values of the cell that index expressions name; outside ones go or take the edge."""
    placed = points.withColumns({"row": row, "col": col})
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    if outside == "clamp":
        placed = placed.withColumns({"row": clamp(F.col("row"), shape[0]), "col": clamp(F.col("col"), shape[1])})
    return placed.join(cells, ["row", "col"])


def matched_sensors(a: DataFrame, b: DataFrame, keys: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Rows of two sensors on the same keys, both present; a share of them by hash of ``key``."""
    out = a.join(b, keys).dropna()
    return out.where(mixed_hash(F.col(key), seed) < share * 100003)


def split_pairs(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs (i, j, day) as sample numbers, with the split of both ends; pairs across splits go."""
    end = lambda x: samples.select(F.col("fid").alias(x), "day", F.col("sample").alias(f"s{x}"), F.col("split").alias(f"p{x}"))
    both = pairs.join(shuffled(end("i")), ["i", "day"]).join(shuffled(end("j")), ["j", "day"])
    return both.where("pi = pj").select("si", "sj", F.col("pi").alias("split"))


def drifted(old: DataFrame, new: DataFrame, km: Column, most_km: float = 0.25) -> DataFrame:
    """Both inventories by id: far where the position has moved, added where the id is new.

    ``km`` is the distance of (lat, lon) and (lat2, lon2).
    """
    both = old.join(new.select("fid", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "fid", "full_outer")
    return both.select("fid", F.coalesce(km > most_km, F.lit(False)).alias("far"), F.col("lat").isNull().alias("added"))


def usable_edges(edges: DataFrame, valid: list[DataFrame], n: int) -> DataFrame:
    """Edges between nodes of all ``valid`` tables, of sources that keep at least n."""
    for nodes in valid:
        edges = edges.join(shuffled(nodes.select(F.col("fid").alias("src")).distinct()), "src", "left_semi")
        edges = edges.join(shuffled(nodes.select(F.col("fid").alias("dst")).distinct()), "dst", "left_semi")
    enough = edges.groupBy("src").count().where(F.col("count") >= n).select("src")
    return edges.join(shuffled(enough), "src", "left_semi")


def daily_maps(df: DataFrame, maps: Mapping[str, str], ts: Column) -> DataFrame:
    """Daily values of each column by its own rule: max, min, avg or sum; ``ts`` is in local time."""
    rules = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    return df.groupBy("fid", F.to_date(ts).alias("day")).agg(*[rules[how](c).alias(f"{c}_{how}") for c, how in maps.items()])


def channels_daily(df: DataFrame, channel: str, value: str, channels: list) -> DataFrame:
    """Daily mean, minimum and range of each channel, one row a station and day."""
    made = []
    for c in channels:
        x = F.when(F.col(channel) == c, F.col(value))
        made += [F.avg(x).alias(f"c{c}_mean"), F.min(x).alias(f"c{c}_min"), (F.max(x) - F.min(x)).alias(f"c{c}_range")]
    return df.groupBy("fid", "day").agg(*made)


def row_stats(columns: list[str]) -> dict[str, Column]:
    """mean, low, range and sd (population) across columns of one row, nulls passed over."""
    held = F.filter(F.array(*columns), lambda x: x.isNotNull())
    size = F.nullif(F.size(held), F.lit(0))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    mean = total / size
    squares = F.aggregate(held, F.lit(0.0), lambda a, x: a + x * x)
    sd = F.sqrt(F.greatest(squares / size - mean * mean, F.lit(0.0)))
    return {"mean": mean, "low": F.array_min(held), "range": F.array_max(held) - F.array_min(held), "sd": sd}


def tallies(df: DataFrame, key: str, columns: list[str], order: Column, position: list[str]) -> DataFrame:
    """Reports of each station, those with each value, and the position first seen."""
    first = [F.min_by(c, order).alias(c) for c in position]
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.count(c).alias(f"has_{c}") for c in columns], *first)


def one_pass(df: DataFrame, keys: list[str], column: str, floor: float = 1e-8) -> DataFrame:
    """n, mean and population deviation (1 below ``floor``) from sums and sums of squares."""
    got = df.groupBy(*keys).agg(F.count(column).alias("n"), F.sum(column).alias("s"), F.sum(F.col(column) * F.col(column)).alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return got.select(*keys, "n", mean.alias("mean"), F.when(sd < floor, 1.0).otherwise(sd).alias("sd"))


def ea_skill(df: DataFrame, keys: list[str], base: str, residual: str, predicted: str, es: str) -> DataFrame:
    """Errors in vapour-pressure space of log residuals, MAPE, and the mean excess over saturation."""
    true, made = F.col(base) * F.exp(residual), F.col(base) * F.exp(predicted)
    gap = made - true
    return df.groupBy(*keys).agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (100 * F.avg(F.abs(gap) / true)).alias("mape"), F.avg(F.greatest(made - F.col(es), F.lit(0.0))).alias("excess"),
    )


def daily_factor(df: DataFrame, value: str, neutral: Column, least: int = 4) -> DataFrame:
    """Daily mean of hourly factors, the neutral one below ``least`` valid hours; ``fallback`` tells which."""
    got = df.groupBy("fid", "day").agg(F.avg(value).alias("factor"), F.count(value).alias("hours"), F.max(neutral).alias("neutral"))
    few = F.col("hours") < least
    return got.select("fid", "day", F.when(few, F.col("neutral")).otherwise(F.col("factor")).alias("factor"), "hours", few.alias("fallback"))


def archive_totals(df: DataFrame, key: str, day: str, size: str, days: int) -> DataFrame:
    """Files, bytes and days of each archive, and bytes extended to a range of ``days``."""
    got = df.groupBy(key).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_distinct(day).alias("days"), F.min(day).alias("first"), F.max(day).alias("last"))
    return got.withColumn("extended", F.col("bytes") / F.col("days") * days)


def facet_facts(df: DataFrame, facet: list[str], aspect: str) -> DataFrame:
    """Size and orientation, by vector sum in degrees, of each facet; flat cells (aspect below 0) only count."""
    a = F.when(F.col(aspect) >= 0, F.radians(aspect))
    got = df.groupBy(*facet).agg(F.count("*").alias("size"), F.sum(F.sin(a)).alias("s"), F.sum(F.cos(a)).alias("c"))
    turned = F.degrees(F.atan2("s", "c"))
    return got.select(*facet, "size", F.when(turned < 0, turned + 360).otherwise(turned).alias("facing"))


def flow_terrain(u: Column, v: Column, slope: Column, aspect: Column) -> tuple[Column, Column, Column]:
    """Upslope and cross-slope flow, and whether the wind is calm (below 1 m/s)."""
    s, c, steep = F.sin(F.radians(aspect)), F.cos(F.radians(aspect)), F.tan(F.radians(slope))
    return -(u * s + v * c) * steep, (u * c - v * s) * steep, met.wind_speed(u, v) < 1


def in_range(day: Column, table: list[tuple[str, str, str]]) -> Column:
    """The name of the first interval (name, first day, last day) that holds the day."""
    out = None
    for name, first, last in table:
        hit = (day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def year_split(df: DataFrame, day: str, train: list[int], held: list[int], ok: Column) -> DataFrame:
    """Rows of the named years with ``split``; days without a supervised row go."""
    year = F.year(day)
    named = df.withColumn("split", F.when(year.isin(train), "train").when(year.isin(held), "val")).where("split is not null")
    return named.join(named.where(ok).select(day).distinct(), day, "left_semi")


def with_gaps(df: DataFrame, key: Column, neighbour: float, step: float, seed: int) -> DataFrame:
    """A share of rows dropped and a share of values zeroed, both by hash."""
    kept = df.where(mixed_hash(key, seed) >= neighbour * 100003)
    return kept.withColumn("zeroed", mixed_hash(key, seed + 1) < step * 100003)


def node_table(df: DataFrame, features: list[str], targets: list[str], holdout: DataFrame, transductive: bool, residual: list[str] = ()) -> DataFrame:
    """Daily nodes: features with nulls as 0 in one array, targets, loss mask of stations that are not held out.

    Held-out stations stay without loss and with their residual inputs at 0
    (transductive), or go (inductive).
    """
    held = F.col("held").isNotNull()
    out = df.join(holdout.select("fid", F.lit(1).alias("held")), "fid", "left")
    if not transductive:
        out = out.where(~held)
    value = lambda c: F.when(held & F.lit(c in residual), F.lit(0.0)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    ok = F.lit(True)
    for t in targets:
        ok &= F.col(t).isNotNull()
    return out.select("day", "fid", F.array(*[value(c) for c in features]).alias("features"), *targets, (ok & ~held).alias("loss"))


def station_graph(edges: DataFrame, stations: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """Static edges with attribute deltas; attributes are scaled to 0..1 by the training stations."""
    ends = stations.join(shuffled(train), "fid", "left_semi").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    low = stations.join(F.broadcast(ends), F.lit(True))  # one row
    scaled = {c: (F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) for c in columns}
    node = low.select("fid", *[x.alias(c) for c, x in scaled.items()])
    a = node.select(F.col("fid").alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = node.select(F.col("fid").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
    out = edges.join(shuffled(a), "src").join(shuffled(b), "dst")
    return out.select(*edges.columns, *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"d_{c}") for c in columns])


def graph_checks(edges: DataFrame, nodes: DataFrame, r_km: float) -> DataFrame:
    """One row: edges, self loops, edges beyond the radius, ends that are no node, repeated edges."""
    known = nodes.select(F.col("fid").alias("dst"), F.lit(1).alias("known")).distinct()
    n = edges.groupBy("src", "dst", "km").agg(F.count("*").alias("n")).join(shuffled(known), "dst", "left")
    return n.agg(
        F.sum("n").alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"), F.count(F.when(F.col("km") > r_km, 1)).alias("far"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
    )


def humidity_drift(df: DataFrame, key: str, year: Column, rh: str) -> DataFrame:
    """The yearly 99th percentile of relative humidity (the value of that rank) and the factor that lifts it to 100."""
    got = quantiles(df.select(key, year.alias("year"), rh), [key, "year"], rh, [0.99], discrete=True)
    return got.select(key, "year", F.col("q")[0].alias("p99"), "n").withColumn("factor", 100 / F.nullif(F.col("p99"), F.lit(0.0)))


def dew_over_minimum(dew: Column, low: Column, wet: Column, most: float = 2.0) -> Column:
    """Dew point above the day's minimum by more than ``most``, except on wet days."""
    return F.coalesce((dew - low > most) & ~F.coalesce(wet, F.lit(False)), F.lit(False))


def hourly_network(df: DataFrame, providers: DataFrame, columns: Mapping[str, str], box: Column) -> DataFrame:
    """Hourly records with their provider's facts, inside a box, without blank ids, in fixed columns.

    A column that the records lack is null ('' for text).
    """
    out = df.join(providers, "provider", "left").where(box & (F.trim("station") != ""))
    empty = lambda t: F.lit("") if t == "string" else F.lit(None).cast(t)
    return out.select(*[(F.col(c).cast(t) if c in out.columns else empty(t)).alias(c) for c, t in columns.items()])


def sites_daily(df: DataFrame, spine: DataFrame, parameters: list[str]) -> DataFrame:
    """First value a day of each parameter on a calendar spine, and each parameter's count at the site."""
    order = Window.partitionBy("fid")
    one = df.groupBy("fid", "day", "parameter").agg(F.min_by("value", "at").alias("value"))
    wide = spine.join(one.groupBy("fid", "day").pivot("parameter", parameters).agg(F.first("value")), ["fid", "day"], "left")
    return wide.withColumns({f"n_{p}": F.count(p).over(order) for p in parameters})


def listing(df: DataFrame, name: str, pattern: str, parts: list[str]) -> DataFrame:
    """Archive names cut into parts by a pattern; names that do not fit go."""
    cut = df.where(F.col(name).rlike(pattern))
    return cut.withColumns({p: F.regexp_extract(name, pattern, i) for i, p in enumerate(parts, 1)})


def clear_pixels(df: DataFrame, value: str, qa: str, low: float, high: float, scale: float) -> DataFrame:
    """Satellite values in range, scaled; below 0 is 0; ``cloud`` is the low two bits of the quality flags, ``miss`` tells of nulls."""
    good = F.when(F.col(value).between(low, high), F.greatest(F.col(value) * scale, F.lit(0.0)))
    return df.withColumns({value: good, "cloud": F.col(qa).bitwiseAND(F.lit(3)), "miss": good.isNull()})


def feathered(df: DataFrame, value: str, tile: str, kernel: list[tuple[int, int, float]], buffer: int) -> DataFrame:
    """Seams between tiles smoothed: alpha * v + (1 - alpha) * focal mean, alpha = distance to the seam over the buffer.

    A cell's distance to the next cell of another tile is sought within the buffer only;
    nulls stay null.
    """
    from .halo import focal, seam_gap

    labelled = df.select("row", "col", tile, value)
    seam = seam_gap(labelled, tile, buffer)
    alpha = F.least(F.coalesce(F.col("gap"), F.lit(float(buffer))) / buffer, F.lit(1.0))
    smooth = focal(seam, kernel, value)
    mixed = alpha * F.col(value) + (1 - alpha) * F.col(f"{value}_focal")
    return smooth.select("row", "col", tile, F.when(F.col(value).isNotNull(), mixed).alias(value))


def effective_height(df: DataFrame, value: str, low: int, mean: int, wide: int) -> DataFrame:
    """Height over its smoothed minimum: minimum, mean of that, difference, mean of the difference (radii in cells)."""
    from .grid import disc, focal

    base = focal(df, disc(low), value, "min").select("row", "col", value, F.col(f"{value}_focal").alias("lowest"))
    base = focal(base, disc(mean), "lowest").withColumn("over", F.col(value) - F.col("lowest_focal"))
    return focal(base.select("row", "col", value, "over"), disc(wide), "over").select("row", "col", F.col("over_focal").alias("height"))


def areal_index(df: DataFrame, value: str, r: int, ramp: tuple[float, float]) -> DataFrame:
    """Inverse-distance mean of heights within r cells (half a cell at the centre), then a ramp from 0 to 1."""
    from .grid import disc, focal

    far = focal(df, disc(r, lambda d2: 1 / max(d2, 0.25) ** 0.5), value)
    up = (F.col(f"{value}_focal") - ramp[0]) / (ramp[1] - ramp[0])
    return far.select("row", "col", F.least(F.greatest(up, F.lit(0.0)), F.lit(1.0)).alias("areal"))
