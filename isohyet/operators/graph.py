"""Node and edge tables, sampling of targets, station-list merges, mosaics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir, shuffled
from .spatial import within
from .stats import mixed_hash


def source_nodes(table: DataFrame, holdout: DataFrame, targets: list[str]) -> DataFrame:
    """Source nodes of each day: not held out, one valid target at least; payload of values and flags."""
    rows = table.join(holdout.select("fid").distinct(), "fid", "left_anti").dropna(how="all", subset=targets)
    payload = [F.coalesce(F.col(t), F.lit(0.0)) for t in targets] + [F.col(t).isNotNull().cast("double") for t in targets]
    return rows.select("day", "fid", F.array(*payload).alias("payload"))


def node_table(
    rows: DataFrame, places: DataFrame, edges: DataFrame, held: DataFrame, weather: list[str], terrain: list[str], targets: list[str], most_abs: float | None = None
) -> DataFrame:
    """(day, fid, x, y, supervised): the nodes of each day's graph as arrays of features, targets and flags.

    x holds the weather columns (0 where ``rows`` lacks one), the places' terrain, the
    mean, the spread and the number of the neighbours' first target on the day, sine and
    cosine of the day of year, latitude and longitude; what is null or not finite is 0.
    Neighbours are the ``dst`` of a station's edges(src, dst) that report on its day;
    ``held`` stations are none, so that no held-out value reaches another node.  A target
    is supervised if it is finite and, with ``most_abs``, no larger than that; else it is 0.
    """
    first = F.col(targets[0]).cast("double")
    seen = rows.join(shuffled(held.select("fid").distinct()), "fid", "left_anti").select(F.col("fid").alias("dst"), "day", first.alias("v"))
    seen = seen.where(_finite(F.col("v")))
    near = edges.select(F.col("src").alias("fid"), "dst").join(shuffled(seen), "dst").groupBy("fid", "day")
    near = near.agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std"), F.count("v").cast("double").alias("_n"))
    doy = 2 * math.pi * F.dayofyear("day") / 365.25
    features = [F.col(c) if c in rows.columns else F.lit(0.0) for c in weather] + [F.col(f"_p.{c}") for c in terrain]
    features += [F.col("_mean"), F.col("_std"), F.col("_n"), F.sin(doy), F.cos(doy), F.col("_p.lat"), F.col("_p.lon")]
    fine = [_finite(F.col(t)) & ((F.abs(t) <= most_abs) if most_abs is not None else F.lit(True)) for t in targets]
    out = rows.join(shuffled(places.select("fid", F.struct("lat", "lon", *terrain).alias("_p"))), "fid", "left").join(shuffled(near), ["fid", "day"], "left")
    clean = lambda c: F.when(_finite(c.cast("double")), c.cast("double")).otherwise(F.lit(0.0))
    return out.select(
        "day", "fid", F.array(*map(clean, features)).alias("x"),
        F.array(*[F.when(ok, F.col(t).cast("double")).otherwise(F.lit(0.0)) for t, ok in zip(targets, fine, strict=True)]).alias("y"),
        F.array(*[F.coalesce(ok, F.lit(False)) for ok in fine]).alias("supervised"),
    )


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))


def day_matrix(stations: DataFrame, table: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """Every station of one day: zeros and a flag of 0 where it has no row."""
    rows = table.where(F.col("day") == day).select("fid", *columns, F.lit(1).alias("present"))
    out = stations.select("fid").distinct().join(rows, "fid", "left")
    return out.na.fill(0, ["present", *columns])


def retrieved(nodes: DataFrame, edges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without excluded ones, numbered from 0 by fid within each day, and the edges between them."""
    left = nodes.join(shuffled(excluded.select("fid").distinct()), "fid", "left_anti")
    left = left.withColumn("local", F.dense_rank().over(Window.partitionBy("day").orderBy("fid")) - 1)
    ids = left.select("day", "fid", "local")
    out = edges.join(shuffled(ids.select("day", F.col("fid").alias("src"), F.col("local").alias("s"))), ["day", "src"])
    out = out.join(shuffled(ids.select("day", F.col("fid").alias("dst"), F.col("local").alias("d"))), ["day", "dst"])
    return left, out.select("day", "s", "d", *[c for c in edges.columns if c not in ("day", "src", "dst")])


def padded(edges: DataFrame, k: int) -> DataFrame:
    """Exactly k neighbours of each source in rank order; the last one is repeated."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "dst")))
    out = edges.where(F.col("rank") <= k).groupBy("src").agg(F.transform(pairs, lambda p: p["dst"]).alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    return out.select("src", "n", at).select("src", "rank", F.element_at("n", F.least("rank", F.size("n"))).alias("dst"))


def with_sentinels(edges: DataFrame, r_km: float) -> DataFrame:
    """Neighbours beyond the radius as index -1, distance 0 and north."""
    far = F.col("km") > r_km
    return edges.select("src", "rank", F.when(far, F.lit(-1)).otherwise(F.col("dst")).alias("dst"), F.when(far, F.lit(0.0)).otherwise(F.col("km")).alias("km"))


def dropped_sources(rows: DataFrame, p: float, seed: int, day: str = "day", key: str = "fid") -> DataFrame:
    """Rows that survive dropout with probability p by hash; one of each day at least."""
    h = mixed_hash(F.col(key) + F.unix_date(day) * 17, seed)
    first = F.row_number().over(Window.partitionBy(day).orderBy(F.desc(h), key)) == 1
    return rows.withColumn("_k", (h >= p * 100003) | first).where("_k").drop("_k")


def tile_sample(points: DataFrame, n: int, seed: int, box: tuple[float, float, float, float]) -> DataFrame:
    """n // tiles points of each of a square number of tiles, topped up by hash order."""
    side = max(1, int(n**0.5))
    w, s, e, north = box
    tx = F.least(F.lit(side - 1), F.floor((F.col("lon") - w) / (e - w) * side))
    ty = F.least(F.lit(side - 1), F.floor((F.col("lat") - s) / (north - s) * side))
    h = mixed_hash(F.col("fid"), seed)
    per = n // (side * side)
    place = F.row_number().over(Window.partitionBy("tile").orderBy("h", "fid"))
    rows = points.withColumns({"tile": (ty * side + tx).cast("long"), "h": h}).withColumn("p", place)
    chosen = rows.where(F.col("p") <= per).withColumn("o", F.lit(0))
    rest = rows.where(F.col("p") > per).withColumn("o", F.lit(1))
    return chosen.unionByName(rest).orderBy("o", "h", "fid").limit(n).select("fid", "tile")


def stars(targets: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Targets with exactly k neighbours inside the sample, as arrays; others drop out."""
    ids = targets.select("fid").distinct()
    e = edges.join(shuffled(ids.withColumnRenamed("fid", "src")), "src", "left_semi").join(shuffled(ids.withColumnRenamed("fid", "dst")), "dst", "left_semi")
    w = Window.partitionBy("src").orderBy("km", "dst")
    e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    pairs = F.array_sort(F.collect_list(F.struct("r", "dst", "km")))
    out = e.groupBy(F.col("src").alias("fid")).agg(F.count("*").alias("n"), pairs.alias("p")).where(F.col("n") == k)
    return out.select("fid", F.transform("p", lambda x: x["dst"]).alias("dst"), F.transform("p", lambda x: x["km"]).alias("km"))


def window_pairs(windows: DataFrame, key: str, start: str, seed: int) -> DataFrame:
    """Each window with another one of its station: the next in hash order, the last with the first."""
    h = mixed_hash(F.col(key) * 31 + F.unix_date(start), seed)
    w = Window.partitionBy(key).orderBy(h, start)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return windows.withColumn("positive", F.coalesce(F.lead(start).over(w), F.first(start).over(whole)))


def spaced(points: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """Greedy sample of points without an edge between any two, in hash order.

    edges(src, dst): pairs closer than the spacing.  In each round a point stays if no
    open neighbour is before it, and its neighbours go.  The first open point always
    stays, so the rounds end, with the greedy result, when no point is open; there are
    as many as the longest chain of points that wait for each other needs.
    """
    rank = lambda c: F.struct(mixed_hash(F.col(c), seed).alias("h"), F.col(c).alias("f"))
    every = points.select("fid").distinct()
    live = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    named = lambda df, c: df.withColumnRenamed("fid", c)
    live = live.join(named(every, "src"), "src", "left_semi").join(named(every, "dst"), "dst", "left_semi").checkpoint()
    near = live.select(F.col("src").alias("fid")).distinct()
    kept = every.join(near, "fid", "left_anti").checkpoint()
    open_, turn = every.join(near, "fid", "left_semi").checkpoint(), 0
    while open_.head(1):
        late = live.where(rank("dst") < rank("src")).select(F.col("src").alias("fid")).distinct()
        stay = open_.join(late, "fid", "left_anti").checkpoint()
        kept, turn = kept.unionByName(stay), turn + 1
        if turn % 20 == 0:  # else the plan grows with the rounds
            kept = kept.checkpoint()
        gone = live.join(named(stay, "src"), "src", "left_semi").select(F.col("dst").alias("fid"))
        open_ = open_.join(stay, "fid", "left_anti").join(gone, "fid", "left_anti").checkpoint()
        live = live.join(named(open_, "src"), "src", "left_semi").join(named(open_, "dst"), "dst", "left_semi").checkpoint()
    return kept


def spaced_by_km(points: DataFrame, r_km: float, seed: int) -> DataFrame:
    """Greedy sample of points of which no two are within r_km, in hash order, without the pairs of points.

    In each round the first open point of each bucket asks whether an open point within
    r_km is before it.  If none is, it stays, and the points within r_km of it go.  The
    first open point of all always stays, so the rounds end with the greedy result; a round
    compares each open point with the few buckets around it.  Points without a place stay.
    """
    shared_dir(points.sparkSession)
    open_ = points.select("fid", "lat", "lon").distinct()
    kept = open_.where("lat is null or lon is null").select("fid").distinct()
    open_ = open_.dropna().withColumn("h", mixed_hash(F.col("fid"), seed)).checkpoint()
    side, turn = r_km / 111.2 / 2, 0
    while open_.head(1):
        bucket = [F.floor(F.col("lat") / side), F.floor(F.col("lon") * F.cos(F.radians(F.floor(F.col("lat") / side) * side)) / side)]
        first = open_.groupBy(*bucket).agg(F.min(F.struct("h", "fid", "lat", "lon")).alias("p")).select("p.*").checkpoint()
        near = within(open_, first, r_km).select("src", "dst").checkpoint()
        order = open_.select(F.col("fid").alias("src"), F.struct("h", "fid").alias("a"))
        other = first.select(F.col("fid").alias("dst"), F.struct("h", "fid").alias("b"))
        late = near.join(shuffled(order), "src").join(shuffled(other), "dst").where("a < b").select(F.col("dst").alias("fid")).distinct()
        stay = first.select("fid").join(shuffled(late), "fid", "left_anti").checkpoint()
        kept, turn = kept.unionByName(stay), turn + 1
        if turn % 20 == 0:  # else the plan grows with the rounds
            kept = kept.checkpoint()
        gone = near.join(shuffled(stay.withColumnRenamed("fid", "dst")), "dst", "left_semi").select(F.col("src").alias("fid"))
        open_ = open_.join(shuffled(stay.unionByName(gone).distinct()), "fid", "left_anti").checkpoint()
    return kept.distinct()


def merged_lists(lists: list[DataFrame], near: float = 0.2) -> DataFrame:
    """Station lists (fid, name, lat) by precedence: an id that recurs with the same name or
    a near latitude is dropped, else renamed with its list's number and flagged."""
    both = None
    for i, df in enumerate(lists):
        part = df.select(F.upper(F.regexp_replace("fid", r"\W+", "_")).alias("fid"), "name", "lat", F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    w = Window.partitionBy("fid").orderBy("list", "name", "lat")
    out = both.withColumns({"r": F.row_number().over(w), "n1": F.first("name").over(w), "l1": F.first("lat").over(w)})
    same = (F.col("name") == F.col("n1")) | (F.abs(F.col("lat") - F.col("l1")) < near)
    out = out.where((F.col("r") == 1) | ~same)
    new = F.when(F.col("r") == 1, F.col("fid")).otherwise(F.concat_ws("_", "fid", "list", "r"))
    return out.select(new.alias("fid"), "name", "lat", "list", (F.col("r") > 1).alias("renamed"))


def mosaic(west: DataFrame, east: DataFrame, split: int, value: str) -> DataFrame:
    """Cells west of a column from one sensor, the others from the other; gaps from whichever has a value."""
    a = west.select("row", "col", F.col(value).alias("a"))
    b = east.select("row", "col", F.col(value).alias("b"))
    first = F.when(F.col("col") < split, F.col("a")).otherwise(F.col("b"))
    return a.join(b, ["row", "col"], "full_outer").select("row", "col", F.coalesce(first, "a", "b").alias(value))


def calibrated(days: DataFrame, candidates: DataFrame, predicted: Column, observed: str, key: str) -> DataFrame:
    """The candidate of least RMSE for each key; the first candidate unless another is better.

    candidates(cand, ...) is a short table of trial coefficients.
    """
    rows = days.join(F.broadcast(candidates), F.lit(True))
    gap = predicted - F.col(observed)
    score = rows.groupBy(key, "cand").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return score.groupBy(key).agg(F.min(F.struct("rmse", "cand")).alias("m")).select(key, F.col("m.cand").alias("cand"), F.col("m.rmse").alias("rmse"))
