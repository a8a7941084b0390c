"""Cell and station indices, patches, probes and station extracts built from other operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing
from ..shared import shuffled
from .spatial import descended, neighbours

def keyed(manifest: DataFrame) -> DataFrame:
    """A manifest with fid, the text after the first colon of station_key, or of key where that column is missing."""
    name = "station_key" if "station_key" in manifest.columns else "key"
    return manifest.withColumn("fid", F.regexp_replace(name, "^[^:]*:", ""))


def comparators(rows: DataFrame, allowed: dict[str, list[str]], sources: list[str], variable: str) -> DataFrame:
    """(fid, day, a column a source): one variable of the sources that may give it; the others stay null.

    rows(fid, source, day, var, value).
    """
    usable = [s for s in sources if variable in allowed.get(s, [])]
    picked = rows.where((F.col("var") == variable) & F.col("source").isin(usable))
    return picked.groupBy("fid", "day").pivot("source", sources).agg(F.first("value", True))


def discovered(targets: list[DataFrame]) -> DataFrame:
    """All stations (fid, lat, lon, elev) of the targets; the first one that has a station places it."""
    both = None
    for i, df in enumerate(targets):
        part = df.select("fid", F.struct(F.lit(i).alias("rank"), "lat", "lon", "elev").alias("p"))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("fid").agg(F.min("p").alias("p"))
    return first.select("fid", "p.lat", "p.lon", "p.elev")


def satellite_cell(lat: Column, lon: Column, north: float, west: float, size: float) -> tuple[Column, Column]:
    """Row from the north and column from the west of the cell whose centre is nearest."""
    return F.round((north - lat) / size).cast("int"), F.round((lon - west) / size).cast("int")


def with_features(rows: DataFrame, pixels: DataFrame, features: list[str]) -> DataFrame:
    """rows(day, row, col, ...) with each feature of the pixel and a flag, 1 where it is missing."""
    out = rows.join(shuffled(pixels.select("day", "row", "col", *features)), ["day", "row", "col"], "left")
    return out.withColumns({f"{f}_miss": F.col(f).isNull().cast("int") for f in features})


def cell_index(cells: DataFrame, stations: DataFrame, k: int = 10, scale: float | None = None) -> DataFrame:
    """(src, dst, rank, km, bsin, bcos): the k nearest stations of each cell at any distance.

    With ``scale`` the rank goes by the distance in three dimensions, heights times scale;
    a station without height has the middle one (within one percent of ranks), a cell 0.
    Cells meet the few nodes of stations that may hold one of their k nearest (``descended``).
    Ties go by id.
    """
    a = cells.select(F.col("fid").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (F.lit(0.0) if scale is None else F.coalesce("elev", F.lit(0.0))).alias("down"))
    z = stations.select(F.col("fid").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (F.lit(0.0) if scale is None else F.col("elev")).alias("up"))
    if scale is not None:
        middle = stations.agg(F.percentile_approx("elev", 0.5).alias("middle"))
        z = z.join(F.broadcast(middle)).withColumn("up", F.coalesce("up", "middle", F.lit(0.0))).drop("middle")
    out = descended(a, z, k, scale)
    angle = bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return out.select("src", "dst", "rank", F.col("flat").alias("km"), F.sin(angle).alias("bsin"), F.cos(angle).alias("bcos"))


def present_edges(index: DataFrame, present: DataFrame) -> DataFrame:
    """(day, s, cell, km): edges from the stations of a day to cells, stations by their number on the day.

    index(src: cell, dst: station, km); present(day, fid).  Numbers count from 0 in id order.
    """
    place = F.row_number().over(Window.partitionBy("day").orderBy("fid")) - 1
    local = present.select("day", "fid").distinct().select("day", place.alias("s"), F.col("fid").alias("dst"))
    return index.select("src", "dst", "km").join(shuffled(local), "dst").select("day", "s", F.col("src").alias("cell"), "km")


def patch_arrays(cells: DataFrame, bands: list[str], norms: DataFrame, size: int, keys: list[str] = ()) -> DataFrame:
    """(keys, tile_row, tile_col, n, one array a band): z-scores in row order, 0 where there is no value.

    norms is one row with mean and deviation of each band, {band}_mean and {band}_std.
    """
    at = {"tile_row": F.floor(F.col("row") / size).cast("int"), "tile_col": F.floor(F.col("col") / size).cast("int")}
    scored = [F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0)).alias(c) for c in bands]
    rows = cells.join(F.broadcast(norms)).withColumns(at).select(*keys, *at, "row", "col", *scored)
    whole = rows.groupBy(*keys, *at).agg(F.array_sort(F.collect_list(F.struct("row", "col", *bands))).alias("p"))
    return whole.select(*keys, *at, F.size("p").alias("n"), *[F.col("p")[c].alias(c) for c in bands])


def sampled_slices(cell_of: DataFrame, slices: DataFrame) -> DataFrame:
    """Each station's rows of its cell: cell_of(fid, cell), slices(cell, ...)."""
    return cell_of.select("fid", "cell").join(shuffled(slices), "cell")


def star_windows(targets: DataFrame, edges: DataFrame, sequences: DataFrame, length: int) -> DataFrame:
    """(fid, day, rank, dst, km, bearing, known, seq): each neighbour's last values on the target's day, zeros where some lack.

    targets(fid, day); edges(src, dst, rank, km, bearing); sequences(fid, end, seq) as series.sequences gives them.
    """
    near = targets.select("fid", "day").join(shuffled(edges.select(F.col("src").alias("fid"), "dst", "rank", "km", "bearing")), "fid")
    seen = sequences.select(F.col("fid").alias("dst"), F.col("end").alias("day"), "seq")
    out = near.join(shuffled(seen), ["dst", "day"], "left").withColumn("known", F.col("seq").isNotNull())
    return out.withColumn("seq", F.coalesce("seq", F.array_repeat(F.lit(0.0), length)))


def filled_stars(edges: DataFrame, stations: DataFrame, records: DataFrame, n: int, holders: int) -> DataFrame:
    """(fid, dst, place, filler, km, bearing): n neighbours of each station, near ones first.

    A station with fewer than n edges(src, dst, rank, km, bearing) is filled from the
    ``holders`` stations with the longest records(fid, days) (ties by id) that are not
    itself and not yet its neighbours, longest first; a filler has distance and bearing 0.
    The holders are one row, an array whose size the parameter bounds.
    """
    near = edges.where(F.col("rank") <= n).select(F.col("src").alias("fid"), "dst", F.col("rank").alias("place"), "km", "bearing")
    longest = records.select("fid", "days").orderBy(F.desc("days"), "fid").limit(holders)
    longest = longest.agg(F.array_sort(F.collect_list(F.struct((-F.col("days")).alias("d"), "fid"))).alias("h"))
    held = near.groupBy("fid").agg(F.collect_list("dst").alias("has"))  # n at most
    short = stations.select("fid").distinct().join(shuffled(held), "fid", "left").withColumn("has", F.coalesce("has", F.array().cast(held.schema["has"].dataType)))
    short = short.where(F.size("has") < n).join(F.broadcast(longest))
    free = F.filter(F.transform("h", lambda x: x["fid"]), lambda x: (x != F.col("fid")) & ~F.array_contains("has", x))
    more = short.select("fid", F.size("has").alias("c"), F.posexplode(F.slice(free, F.lit(1), n - F.size("has"))).alias("i", "dst"))
    more = more.select("fid", "dst", (F.col("c") + F.col("i") + 1).alias("place"), F.lit(True).alias("filler"), F.lit(0.0).alias("km"), F.lit(0.0).alias("bearing"))
    return near.withColumn("filler", F.lit(False)).select(*more.columns).unionByName(more)


def star_samples(targets: DataFrame, stars: DataFrame, obs: DataFrame, value: str, outer: list[str], length: int) -> DataFrame:
    """The sequences of each target day's star: (fid, day, place, dst, filler, km, bearing,
    known, today, lagged, {outer}_seq, {outer}_delta).

    targets(fid, day); obs(fid, day, value, outer).  A neighbour is known where it has
    ``length`` consecutive days up to the target's day: ``lagged`` are its values one day
    late (the first one twice, so that the day's own value is not among them), ``today``
    is that value, and the outer columns go along, with the target's less the
    neighbour's of the day.  Else all of these are 0.
    """
    run = Window.partitionBy("fid").orderBy("day").rowsBetween(-(length - 1), 0)
    rows = obs.where(F.col(value).isNotNull()).select("fid", "day", F.col(value).cast("double").alias("_v"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in outer])
    kept = rows.select(F.col("fid").alias("dst"), "day", F.collect_list(F.struct("_v", *outer)).over(run).alias("w"), F.min("day").over(run).alias("a"))
    kept = kept.where((F.size("w") == length) & (F.datediff("day", "a") == length - 1)).drop("a")
    own = rows.select("fid", "day", F.struct(*outer).alias("own"))
    out = targets.select("fid", "day").join(shuffled(own), ["fid", "day"], "left").join(shuffled(stars), "fid").join(shuffled(kept), ["dst", "day"], "left")
    zeros, last = F.array_repeat(F.lit(0.0), length), F.get("w", F.lit(length - 1))
    values = F.transform("w", lambda x: x["_v"])
    lagged = F.concat(F.slice(values, 1, 1), F.slice(values, 1, length - 1))
    made = [F.col("w").isNotNull().alias("known"), F.coalesce(last["_v"], F.lit(0.0)).alias("today"), F.coalesce(lagged, zeros).alias("lagged")]
    for c in outer:
        made.append(F.coalesce(F.transform("w", lambda x: x[c]), zeros).alias(f"{c}_seq"))
        made.append((F.coalesce(F.col(f"own.{c}"), F.lit(0.0)) - F.coalesce(last[c], F.lit(0.0))).alias(f"{c}_delta"))
    return out.select("fid", "day", "place", "dst", "filler", "km", "bearing", *made)


def same_day_neighbours(points: DataFrame, m: int, values: list[str], norms: DataFrame, r_km: float = 150.0) -> DataFrame:
    """(fid, day, rank, dst, km, z-score and known flag a value): the m nearest stations within r_km that report on the day.

    points(fid, day, lat, lon, values), a row for each report; norms is one row of
    {value}_mean and {value}_std.  Neighbours are sought among a day's reports alone, in
    a radius that widens only for reports that lack m, so that candidates grow with the
    reports and not with the pairs of stations.
    """
    other = points.select(F.col("fid").alias("dst"), "day", *values)
    near = neighbours(points, points, m, r_km, keys=["day"]).select("src", "day", "rank", "dst", "km")
    met = near.join(shuffled(other), ["dst", "day"]).join(F.broadcast(norms))  # one row
    made = []
    for v in values:
        made.append(F.coalesce((F.col(v) - F.col(f"{v}_mean")) / F.nullif(F.col(f"{v}_std"), F.lit(0.0)), F.lit(0.0)).alias(v))
        made.append(F.col(v).isNotNull().alias(f"{v}_known"))
    return met.select(F.col("src").alias("fid"), "day", "rank", "dst", "km", *made)


def probe(rows: DataFrame, group: str, vector: str, target: str, least: int = 8) -> DataFrame:
    """(group, n, r2) of a linear regression of target on a vector; groups below ``least`` rows drop out.

    Tasks add up products of their rows, Spark adds these up by place, and each group's
    small system is solved from the sums.  Rows with a null, or a vector of another
    length than most, are not used; r2 is null where the target does not vary.
    """
    rows = rows.where(F.col(target).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(group, vector, target)
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths.d if lengths else 0
    kind = dict(rows.dtypes)[group]

    def add(parts):
        sums: dict = {}
        for pdf in parts:
            for key, part in pdf.groupby(group, dropna=False):
                x = np.column_stack([np.ones(len(part)), np.stack(part[vector].to_numpy()), part[target].to_numpy(float)])
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, total in sums.items():
            yield pd.DataFrame({group: [key], "s": [total.ravel().tolist()]})

    def solve(parts):
        for pdf in parts:
            out = []
            for key, flat in zip(pdf[group], pdf["s"], strict=True):
                s = np.array(flat).reshape(d + 2, d + 2)
                n, mean = s[0, 0], s[0] / s[0, 0]
                spread = s - n * np.outer(mean, mean)
                xx, xy, yy = spread[1:-1, 1:-1], spread[1:-1, -1], spread[-1, -1]
                coef = np.linalg.lstsq(xx, xy, rcond=1e-10)[0]
                rest = yy - 2 * coef @ xy + coef @ xx @ coef
                out.append((key, int(n), 1 - rest / yy if yy > 1e-12 * s[-1, -1] else None))
            yield pd.DataFrame(out, columns=[group, "n", "r2"])

    part = rows.where(F.size(vector) == d).mapInPandas(add, f"{group} {kind}, s array<double>")
    placed = part.select(group, F.posexplode("s").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("x"))
    whole = placed.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))
    return whole.where(F.col("s")[0] >= least).mapInPandas(solve, f"{group} {kind}, n long, r2 double")
