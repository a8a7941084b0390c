"""Canonical columns, table checks, source joins, daily summaries, terrain chains and graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, met
from ..operators import grid, qc, series, spatial, stats, tables
from ..shared import shared_dir, shuffled
from . import bindings as b
from .queries_rows import HAV
from .queries_sets import NB, H
from .registry import QUERIES, SQL, query

DAYNO = "date_diff('day', DATE '1970-01-01', day)"
D2 = "((q.row - a.row) * (q.row - a.row) + (q.col - a.col) * (q.col - a.col))"
_RAW = SQL["g01_slope_aspect"].replace("round(degrees(atan(sqrt(dx * dx + dy * dy))), 5)", "degrees(atan(sqrt(dx * dx + dy * dy)))")
SLOPE = f"sl AS ({_RAW.replace('round(CASE', '(CASE').replace('END, 4) AS aspect', 'END) AS aspect')})"  # not rounded


def dayno(c="day"):
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def by_source(spark, d, n=3):
    """(fid, day, source, value): the hourly values dealt to n sources."""
    h = b.hourly(spark, d).withColumn("source", F.concat(F.lit("p"), (F.col("event_id") % n).cast("string")))
    return h.groupBy("fid", "day", "source").agg(F.avg("value").alias("value"))


BS = lambda n=3: f"bs AS (SELECT fid, day, 'p' || (event_id % {n}) AS source, avg(value) AS value FROM ev GROUP BY 1, 2, 3)"


@query("SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END AS a FROM lineitem")
def p03_old_flags(spark, d):
    s = b.sensors(spark, d)
    return s.select("k", "line", F.when(F.col("channel").isin("A", "R"), F.col("a")).alias("a"))


@query(f"WITH {b.EV} SELECT event_id, round(value, 6) AS value, round(u, 6) AS u, round(v, 6) AS v FROM ev WHERE value IS NOT NULL AND value BETWEEN 0 AND 50 AND abs(u) <= 20 AND abs(v) <= 20")
def p08_wind_rows(spark, d):
    h = b.hourly(spark, d).select("event_id", "value", "u", "v")
    return b.rounded(h.where(F.col("value").between(0, 50) & (F.abs("u") <= 20) & (F.abs("v") <= 20)))


@query(f"WITH {b.DD} SELECT fid, day, round(CASE WHEN obs BETWEEN 5 AND 80 THEN obs END, 6) AS obs, round(CASE WHEN abs(delta) <= 30 THEN delta END, 6) AS delta FROM dd", dates=("day",))
def p09_bounds_then_outliers(spark, d):
    out = qc.limited(b.daily_obs(spark, d), {"obs": (5, 80), "delta": (-30, 30)})
    return b.rounded(out.select("fid", "day", "obs", "delta"))


@query(f"WITH {b.DD} SELECT fid, day, round(top, 6) AS gust_rtma, round(obs, 6) AS tmp_rtma, round(low, 6) AS sx_090_2k, round(base, 6) AS sx_180_10k FROM dd", dates=("day",))
def p14_columns(spark, d):
    x = b.daily_obs(spark, d).select("fid", "day", F.col("obs").alias("tmp_rtma"), F.col("top").alias("gust_rtma"), F.col("delta").alias("delta_tmp_rtma"), F.col("base").alias("sx_180_10k"), F.col("low").alias("sx_090_2k"), F.col("n").alias("sx_090_5k"))
    return b.rounded(x.select("fid", "day", *tables.feature_columns(x.columns, "rtma")))


@query(f"WITH {b.EV} SELECT event_id, round(value, 6) AS tmp_m, round(u, 6) AS u_m, round(v, 6) AS v_m, round(sqrt(u * u + v * v), 6) AS wind_m FROM ev")
def p15_canonical(spark, d):
    h = b.hourly(spark, d).select("event_id", F.col("value").alias("t2m"), F.col("u").alias("ugrd"), F.col("v").alias("vgrd"))
    out = tables.canonical(h, {"tmp": ["tmp", "t2m"], "u": ["u10", "ugrd"], "v": ["v10", "vgrd"], "q": ["spfh"]}, "m")
    return b.rounded(out.drop("wdir_m"))


@query("SELECT event_id, strftime(CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('hour', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 3 < 2")
def p17_times(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyyMMddHH")).otherwise(F.lit("n/a"))
    out = tables.parsed_times(b.table(spark, d, "events").select("event_id", text.alias("at")), "at")
    return out.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"""WITH {b.DD}, x AS (SELECT fid, day, CASE WHEN fid % 3 = 0 THEN 0.0 ELSE obs END AS x, CASE WHEN fid % 2 = 0 THEN NULL ELSE delta END AS y FROM dd),
w AS (SELECT *, max(abs(coalesce(x, 0))) OVER (PARTITION BY fid) AS mx, max(abs(coalesce(y, 0))) OVER (PARTITION BY fid) AS my FROM x)
SELECT fid, day, round(CASE WHEN mx <> 0 THEN x END, 6) AS x, round(CASE WHEN my <> 0 THEN y END, 6) AS y FROM w WHERE (mx <> 0 AND x IS NOT NULL) OR (my <> 0 AND y IS NOT NULL)""", dates=("day",))
def p20_void_targets(spark, d):
    o = b.daily_obs(spark, d)
    x = o.select("fid", "day", F.when(F.col("fid") % 3 == 0, 0.0).otherwise(F.col("obs")).alias("x"), F.when(F.col("fid") % 2 != 0, F.col("delta")).alias("y"))
    return b.rounded(tables.without_void(x, "fid", ["x", "y"]))


@query("""SELECT 'lengths' AS rule, count(DISTINCT len(embedding)) - 1 AS bad FROM embeddings UNION ALL SELECT 'vectors', count(*) FILTER (embedding IS NULL) FROM embeddings
UNION ALL SELECT 'attributes', count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'names', 1""")
def p22_contract(spark, d):
    return tables.contract(b.vectors(spark, d), "vec", "fid", b.stations(spark, d), ["fid", "vec", "missing_obs"])


@query(f"WITH {b.DD} SELECT fid, day, round(CASE WHEN abs(delta) <= 20 THEN delta ELSE 0 END, 6) AS delta, coalesce(abs(delta) <= 20, false) AS delta_ok FROM dd WHERE base IS NOT NULL", dates=("day",))
def p23_supervised(spark, d):
    out = tables.supervised(b.daily_obs(spark, d), "base", ["delta"], 20.0)
    return b.rounded(out.select("fid", "day", "delta", "delta_ok"))


@query(f"WITH {b.DD}, {BS()} SELECT dd.fid, dd.day, round(obs, 6) AS obs, round(a.value, 6) AS value_p0, round(z.value, 6) AS value_p1, round(y.value, 6) AS value_p2 FROM dd LEFT JOIN bs a ON a.fid = dd.fid AND a.day = dd.day AND a.source = 'p0' LEFT JOIN bs z ON z.fid = dd.fid AND z.day = dd.day AND z.source = 'p1' LEFT JOIN bs y ON y.fid = dd.fid AND y.day = dd.day AND y.source = 'p2'", dates=("day",))
def j01_chained(spark, d):
    s = by_source(spark, d)
    others = {p: s.where(F.col("source") == p).drop("source") for p in ("p0", "p1", "p2")}
    return b.rounded(tables.chained(b.daily_obs(spark, d).select("fid", "day", "obs"), others, ["fid", "day"]))


@query(f"WITH {b.DD}, f AS (SELECT fid, day, max(u) AS top, min(v) AS gust FROM ev WHERE event_id % 2 = 0 GROUP BY 1, 2) SELECT dd.fid, dd.day, round(obs, 6) AS obs, round(f.top, 6) AS top, round(f.gust, 6) AS gust FROM dd LEFT JOIN f ON f.fid = dd.fid AND f.day = dd.day", dates=("day",))
def j03_family(spark, d):
    f = b.hourly(spark, d).where("event_id % 2 = 0").groupBy("fid", "day").agg(F.max("u").alias("top"), F.min("v").alias("gust"))
    return b.rounded(tables.with_family(b.daily_obs(spark, d).select("fid", "day", "obs", "top"), f, ["fid", "day"]))


@query(f"WITH {b.DD}, {b.ST} SELECT dd.fid, day, round(obs, 6) AS obs, elev, round(lat, 6) AS lat FROM dd LEFT JOIN st ON st.fid = dd.fid", dates=("day",))
def j04_static(spark, d):
    return b.rounded(tables.with_static(b.daily_obs(spark, d).select("fid", "day", "obs"), b.stations(spark, d).select("fid", "elev", "lat"), "fid"))


@query(f"WITH {b.DD}, x AS (SELECT fid, CASE WHEN fid % 5 = 0 THEN day + 40000 ELSE day END AS day FROM dd) SELECT DISTINCT fid FROM x WHERE fid NOT IN (SELECT x.fid FROM x JOIN dd ON dd.fid = x.fid AND dd.day = x.day)")
def j06_misaligned(spark, d):
    o = b.daily_obs(spark, d)
    moved = o.select("fid", F.when(F.col("fid") % 5 == 0, F.date_add("day", 40000)).otherwise(F.col("day")).alias("day"))
    return tables.misaligned(moved, o, "fid", "day")


@query(f"WITH {b.DD}, {BS(4)}, w AS (SELECT fid, day, avg(value) FILTER (source = 'p0') AS p0, avg(value) FILTER (source = 'p1') - 273.15 AS p1, CAST(NULL AS DOUBLE) AS p9 FROM bs GROUP BY 1, 2) SELECT dd.fid, dd.day, round(obs, 6) AS obs, round(p0, 6) AS p0, round(p1, 6) AS p1, p9 FROM dd LEFT JOIN w ON w.fid = dd.fid AND w.day = dd.day WHERE obs IS NOT NULL", dates=("day",))
def j07_aligned(spark, d):
    s = by_source(spark, d, 4).withColumnRenamed("source", "product")
    return b.rounded(tables.aligned(b.daily_obs(spark, d).select("fid", "day", "obs"), s, ["p0", "p1", "p9"], ("p1",)))


@query(f"WITH {b.DD}, {BS()} SELECT dd.fid, source, count(*) AS n, round(avg(value - obs) + 1e-9, 6) AS bias, round(avg(abs(value - obs)) + 1e-9, 6) AS mae FROM dd JOIN bs ON bs.fid = dd.fid AND bs.day = dd.day WHERE obs IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def j08_compared(spark, d):
    out = tables.compared(b.daily_obs(spark, d), by_source(spark, d).withColumnRenamed("value", "pred"))
    # means of a few values stand on the very edge of rounding, where the order of a sum decides
    return b.rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("bias", "mae")}))


@query(f"WITH {b.DD}, f AS (SELECT fid, day, avg(1 + u / 1000) AS f FROM ev WHERE event_id % 2 = 0 GROUP BY 1, 2) SELECT dd.fid, dd.day, round(CASE WHEN z <> 10 AND z > 0.2 THEN coalesce(f, ln(67.8 * 10 - 5.42) / ln(67.8 * z - 5.42)) ELSE 1 END, 6) AS factor FROM (SELECT *, CAST(fid % 12 AS DOUBLE) AS z FROM dd) dd LEFT JOIN f ON f.fid = dd.fid AND f.day = dd.day", dates=("day",))
def j09_height_factor(spark, d):
    f = b.hourly(spark, d).where("event_id % 2 = 0").groupBy("fid", "day").agg(F.avg(1 + F.col("u") / 1000).alias("f"))
    o = b.daily_obs(spark, d).join(f, ["fid", "day"], "left")
    return b.rounded(o.select("fid", "day", tables.height_factor((F.col("fid") % 12).cast("double"), F.col("f")).alias("factor")))


DOY = "CAST(least(dayofyear(day), 365) AS INT)"


@query(f"WITH {b.DD}, l AS (SELECT fid, {DOY} AS doy, max(top) AS clear FROM dd GROUP BY 1, 2) SELECT dd.fid, dd.day, l.doy, round(obs, 6) AS obs, round(base, 6) AS base, round(clear * 0.0036, 6) AS clear, coalesce(top > 90, false) AS high FROM dd JOIN l ON l.fid = dd.fid AND l.doy = {DOY} WHERE obs IS NOT NULL", dates=("day",))
def w13_training_frame(spark, d):
    o = b.daily_obs(spark, d)
    lookup = o.groupBy("fid", F.least(F.dayofyear("day"), F.lit(365)).alias("doy")).agg((F.max("top") * 0.0036).alias("clear"))
    out = tables.by_doy(o.where("obs is not null"), lookup, "fid", "day")
    return b.rounded(out.select("fid", "day", "doy", "obs", "base", "clear", F.coalesce(F.col("top") > 90, F.lit(False)).alias("high")))


@query(f"WITH {b.DD}, l AS (SELECT fid, {DOY} AS doy, avg(base) AS clear FROM dd WHERE fid % 2 = 0 GROUP BY 1, 2) SELECT dd.fid, dd.day, round(clear, 6) AS clear FROM dd LEFT JOIN l ON l.fid = dd.fid AND l.doy = {DOY}", dates=("day",))
def j10_by_doy(spark, d):
    o = b.daily_obs(spark, d)
    lookup = o.where("fid % 2 = 0").groupBy("fid", F.least(F.dayofyear("day"), F.lit(365)).alias("doy")).agg(F.avg("base").alias("clear"))
    return b.rounded(tables.by_doy(o, lookup, "fid", "day").select("fid", "day", "clear"))


@query(f"WITH {b.ST}, {b.GR}, p AS (SELECT fid, CAST(least(greatest(round_even(elev / 100, 0), 0), 3) AS INT) AS row, CAST(least(greatest(trunc((lon + 125) * 3), 0), 49) AS INT) AS col FROM st) SELECT fid, p.row, p.col, round(z, 6) AS z FROM p JOIN gr ON gr.row = p.row AND gr.col = p.col")
def j19_at_cells(spark, d):
    row, col = F.bround(F.col("elev") / 100).cast("int"), ((F.col("lon") + 125) * 3).cast("int")
    out = tables.at_cells(b.stations(spark, d).select("fid", "elev", "lon"), b.cells(spark, d).select("row", "col", "z"), row, col, (4, 50), "clamp")
    return b.rounded(out.select("fid", "row", "col", "z"))


@query(f"""WITH {b.DD}, {b.ST}, {NB}, w AS (SELECT fid, day, avg(u) AS u, avg(v) AS v FROM ev GROUP BY 1, 2)
SELECT w.day, nb.src, nb.dst, round(km, 6) AS km, round(s.elev - t.elev, 6) AS d_elev,
 round(cos(atan2(-w.u, -w.v) - atan2(sin(radians(t.lon - s.lon)) * cos(radians(t.lat)), cos(radians(s.lat)) * sin(radians(t.lat)) - sin(radians(s.lat)) * cos(radians(t.lat)) * cos(radians(t.lon - s.lon)))), 5) AS upwind
FROM nb JOIN st s ON s.fid = nb.src JOIN st t ON t.fid = nb.dst JOIN w ON w.fid = nb.src JOIN w x ON x.fid = nb.dst AND x.day = w.day WHERE rank <= 4 AND nb.dst % 10 <> 0""", dates=("day",))
def j22_terrain_edges(spark, d):
    s = b.stations(spark, d)
    e = spatial.neighbours(s, s, 4, 150.0).where("dst % 10 <> 0")
    w = b.hourly(spark, d).groupBy("fid", "day").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    side = lambda x: s.select(F.col("fid").alias(x), F.col("elev").alias(f"e_{x}"))
    out = e.join(shuffled(side("src")), "src").join(shuffled(side("dst")), "dst").join(shuffled(w.withColumnRenamed("fid", "src")), "src")
    out = out.join(shuffled(w.select(F.col("fid").alias("dst"), "day")), ["dst", "day"])
    up, _ = geo.upwind(F.col("u"), F.col("v"), F.col("bearing"))
    return out.select("day", "src", "dst", F.round("km", 6).alias("km"), F.round(F.col("e_src") - F.col("e_dst"), 6).alias("d_elev"), F.round(up, 5).alias("upwind"))


@query(f"WITH {b.SE}, s AS (SELECT channel, day, avg(a) AS x FROM se GROUP BY 1, 2) SELECT r.day, round(r.x, 6) AS r, round(n.x, 6) AS n FROM s r JOIN s n ON n.day = r.day WHERE r.channel = 'R' AND n.channel = 'A' AND {H(DAYNO.replace('day)', 'r.day)'), 5)} < 50001", dates=("day",))
def j28_matched_sensors(spark, d):
    s = b.sensors(spark, d).groupBy("channel", "day").agg(F.avg("a").alias("x"))
    one = lambda c: s.where(F.col("channel") == c).select("day", F.col("x").alias("r" if c == "R" else "n"))
    out = tables.matched_sensors(one("R").withColumn("no", dayno()), one("A"), ["day"], "no", 50001 / 100003, 5)
    return b.rounded(out.select("day", "r", "n"))


@query(f"""WITH {b.DD}, {b.ST}, {NB}, s AS (SELECT fid, day, fid * 100000 + {DAYNO} AS sample, CASE WHEN {H('fid', 3)} < 70000 THEN 'train' ELSE 'val' END AS split FROM dd)
SELECT i.sample AS si, j.sample AS sj, i.split FROM nb JOIN s i ON i.fid = nb.src JOIN s j ON j.fid = nb.dst AND j.day = i.day WHERE rank <= 3 AND i.split = j.split""")
def j29_split_pairs(spark, d):
    s, o = b.stations(spark, d), b.daily_obs(spark, d)
    split = F.when(stats.mixed_hash(F.col("fid"), 3) < 70000, "train").otherwise("val").alias("split")
    samples = o.select("fid", "day", (F.col("fid") * 100000 + dayno()).alias("sample"), split)
    e = spatial.neighbours(s, s, 3, 150.0).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    return tables.split_pairs(e.join(shuffled(o.select(F.col("fid").alias("i"), "day")), "i"), samples)


@query(f"""WITH {b.ST}, n AS (SELECT CASE WHEN fid % 4 = 0 THEN fid + 1000000 ELSE fid END AS fid, lat + 0.01 * (fid % 2) AS lat, lon FROM st)
SELECT coalesce(st.fid, n.fid) AS fid, coalesce({HAV.format(a='st', d='n')} > 0.25, false) AS far, st.lat IS NULL AS added FROM st FULL JOIN n ON n.fid = st.fid""")
def j32_drift(spark, d):
    s = b.stations(spark, d).select("fid", "lat", "lon")
    moved = s.select(F.when(F.col("fid") % 4 == 0, F.col("fid") + 1000000).otherwise(F.col("fid")).alias("fid"), (F.col("lat") + 0.01 * (F.col("fid") % 2)).alias("lat"), "lon")
    return tables.drifted(s, moved, geo.distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))


@query(f"""WITH {b.EV}, {b.ST}, {NB}, ok AS (SELECT fid FROM ev INTERSECT SELECT fid FROM st WHERE fid % 3 <> 0), e AS (SELECT src, dst, km FROM nb WHERE rank <= 6 AND src IN (FROM ok) AND dst IN (FROM ok))
SELECT src, dst, round(km, 6) AS km FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) >= 3)""")
def j35_usable_edges(spark, d):
    s = b.stations(spark, d)
    e = spatial.neighbours(s, s, 6, 150.0).select("src", "dst", "km")
    return b.rounded(tables.usable_edges(e, [b.hourly(spark, d), s.where("fid % 3 <> 0")], 3))


CE = "ce AS (SELECT row * 50 + col AS fid, row, col, 42 + row * 0.02 AS lat, -125 + col * 0.4 AS lon, z FROM gr)"


def placed_cells(spark, d):
    return b.cells(spark, d).select((F.col("row") * 50 + F.col("col")).alias("fid"), "row", "col", (42 + F.col("row") * 0.02).alias("lat"), (-125 + F.col("col") * 0.4).alias("lon"), "z")


@query(f"""WITH {b.ST}, {b.GR}, {CE}, x AS (SELECT st.fid, ce.fid AS cell, {HAV.format(a='st', d='ce')} AS km, elev - z AS above, z, row_number() OVER (PARTITION BY st.fid ORDER BY {HAV.format(a='st', d='ce')}, ce.fid) AS r FROM st, ce)
SELECT fid, cell, round(km, 5) AS km, round(above, 6) AS above, round(z, 6) AS z FROM x WHERE r = 1""")
def j38_nearest_cell(spark, d):
    """Nearest cell of each station, its value and its relative height."""
    shared_dir(spark)
    s, c = b.stations(spark, d), placed_cells(spark, d)
    near = spatial.nearest(s.select("fid", "lat", "lon"), c.select("fid", "lat", "lon"), 25.0)
    out = near.select(F.col("src").alias("fid"), F.col("dst").alias("cell"), "km").join(shuffled(s.select("fid", "elev")), "fid").join(shuffled(c.select(F.col("fid").alias("cell"), "z")), "cell")
    return out.select("fid", "cell", F.round("km", 5).alias("km"), F.round(F.col("elev") - F.col("z"), 6).alias("above"), F.round("z", 6).alias("z"))


@query(f"WITH {b.ST}, {b.GR}, {CE} SELECT st.fid, count(*) AS n, round(min({HAV.format(a='st', d='ce')}), 5) AS km, round(avg(z), 5) AS z FROM st JOIN ce ON {HAV.format(a='st', d='ce')} <= 60 GROUP BY 1")
def g20_cells_in_radius(spark, d):
    c = placed_cells(spark, d)
    near = spatial.within(b.stations(spark, d), c, 60.0, keep_self=True).select("src", "dst", "km").join(shuffled(c.select(F.col("fid").alias("dst"), "z")), "dst")
    return near.groupBy(F.col("src").alias("fid")).agg(F.count("*").alias("n"), F.round(F.min("km"), 5).alias("km"), F.round(F.avg("z"), 5).alias("z"))


@query(f"WITH {b.EV} SELECT fid, day, round(avg(sqrt(u * u + v * v)), 6) AS wind, round(max(value), 6) AS value_max FROM ev GROUP BY 1, 2", dates=("day",))
def a03_wind_and_gust(spark, d):
    h = b.hourly(spark, d)
    out = series.vector_daily(h, "fid", "ts", "u", "v").select("fid", "day", "wind")
    return b.rounded(out.join(tables.daily_maps(h, {"value": "max"}, F.col("ts")), ["fid", "day"], "left"))


@query(f"WITH {b.EV} SELECT fid, CAST(ts - INTERVAL 7 HOUR AS DATE) AS day, round(max(value), 6) AS value_max, round(avg(u), 6) AS u_avg, round(min(v), 6) AS v_min FROM ev GROUP BY 1, 2", dates=("day",))
def a04_daily_maps(spark, d):
    return b.rounded(tables.daily_maps(b.hourly(spark, d), {"value": "max", "u": "avg", "v": "min"}, F.expr("ts - INTERVAL 7 HOURS")))


@query(f"WITH {b.EV} SELECT fid, day, " + ", ".join(f"round(avg(value) FILTER (event_id % 2 = {c}), 6) AS c{c}_mean, round(min(value) FILTER (event_id % 2 = {c}), 6) AS c{c}_min, round(max(value) FILTER (event_id % 2 = {c}) - min(value) FILTER (event_id % 2 = {c}), 6) AS c{c}_range" for c in (0, 1)) + " FROM ev GROUP BY 1, 2", dates=("day",))
def a08_channels(spark, d):
    h = b.hourly(spark, d).withColumn("channel", F.col("event_id") % 2)
    return b.rounded(tables.channels_daily(h, "channel", "value", [0, 1]))


@query(f"WITH {b.EV}, {b.ST} SELECT st.fid, any_value(elev) AS elev, round(any_value(lat), 6) AS lat, round(avg(value), 6) AS value, count(value) AS n FROM st LEFT JOIN ev ON ev.fid = st.fid GROUP BY 1")
def a12_station_means(spark, d):
    means = b.hourly(spark, d).groupBy("fid").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    out = tables.with_static(b.stations(spark, d).select("fid", "elev", "lat"), means, "fid")
    return b.rounded(out.withColumn("n", F.coalesce("n", F.lit(0))))


@query(f"WITH {b.EV} SELECT fid, count(*) AS n, count(value) AS has_value, count(CASE WHEN u > 0 THEN u END) AS has_up, round(arg_min(u, event_id), 6) AS u FROM ev GROUP BY 1")
def a13_tallies(spark, d):
    h = b.hourly(spark, d).withColumn("up", F.when(F.col("u") > 0, F.col("u")))
    return b.rounded(tables.tallies(h, "fid", ["value", "up"], F.col("event_id"), ["u"]))


@query(f"WITH {b.SE} SELECT channel, count(a) AS n, round(avg(a), 5) AS mean, round(stddev_pop(a), 5) AS sd FROM se GROUP BY 1")
def a17_one_pass(spark, d):
    return b.rounded(tables.one_pass(b.sensors(spark, d), ["channel"], "a"), 5)


@query(f"WITH {b.ST}, {NB} SELECT count(km) AS n, round(avg(km), 5) AS mean, round(stddev_pop(km), 5) AS sd FROM nb WHERE rank <= 8")
def a21_edge_norm(spark, d):
    s = b.stations(spark, d)
    return b.rounded(tables.one_pass(spatial.neighbours(s, s, 8, 150.0), [], "km"), 5)


@query(f"""WITH {b.DD}, x AS (SELECT fid, 1.2 * exp(delta / 1000) AS t, 1.2 * exp(delta / 2000) AS m FROM dd)
SELECT fid, round(avg(abs(m - t)), 6) AS mae, round(sqrt(avg((m - t) * (m - t))), 6) AS rmse, round(100 * avg(abs(m - t) / t), 6) AS mape, round(avg(greatest(m - 1.21, 0)), 6) AS excess FROM x GROUP BY 1""")
def a26_vapour_skill(spark, d):
    o = b.daily_obs(spark, d).select("fid", F.lit(1.2).alias("base"), (F.col("delta") / 1000).alias("r"), (F.col("delta") / 2000).alias("p"), F.lit(1.21).alias("es"))
    return b.rounded(tables.ea_skill(o, ["fid"], "base", "r", "p", "es"))


@query(f"""WITH {b.EV}, x AS (SELECT fid, day, avg(f) AS f, count(f) AS hours FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN 1 + u / 1000 END AS f FROM ev) GROUP BY 1, 2)
SELECT fid, day, round(CASE WHEN hours < 2 THEN ln(672.58) / ln(67.8 * 3 - 5.42) ELSE f END, 6) AS factor, hours, hours < 2 AS fallback FROM x""", dates=("day",))
def a28_daily_factor(spark, d):
    h = b.hourly(spark, d).withColumn("f", F.when(F.col("event_id") % 3 > 0, 1 + F.col("u") / 1000))
    return b.rounded(tables.daily_factor(h, "f", met.neutral_factor(F.lit(3.0)), 2))


NAME = "'model' || (o_custkey % 3) || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '.idx.bad' ELSE '.grib2' END"


def archive(spark, d):
    o = b.table(spark, d, "orders")
    end = F.when(F.col("o_orderkey") % 5 == 0, ".idx.bad").otherwise(".grib2")
    name = F.concat(F.lit("model"), (F.col("o_custkey") % 3).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), end)
    files = o.select("o_orderkey", name.alias("name"), F.col("o_totalprice").cast("long").alias("size"))
    return tables.listing(files, "name", r"^(model\d)_(\d{8})_(\d\d)\.(\w+)$", ["model", "day", "hour", "suffix"])


@query(f"SELECT o_orderkey, {NAME} AS name, CAST(trunc(o_totalprice) AS BIGINT) AS size, 'model' || (o_custkey % 3) AS model, strftime(o_orderdate, '%Y%m%d') AS day, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS hour, 'grib2' AS suffix FROM orders WHERE o_orderkey % 5 <> 0")
def src19_listing(spark, d):
    return archive(spark, d)


@query("SELECT 'model' || (o_custkey % 3) AS model, count(*) AS files, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, strftime(min(o_orderdate), '%Y%m%d') AS first, strftime(max(o_orderdate), '%Y%m%d') AS last, round(sum(CAST(trunc(o_totalprice) AS BIGINT)) / count(DISTINCT CAST(o_orderdate AS DATE)) * 4688, 3) AS extended FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def a29_archive_totals(spark, d):
    return b.rounded(tables.archive_totals(archive(spark, d), "model", "day", "size", 4688), 3)


@query(f"""WITH {SLOPE}, x AS (SELECT CAST(row // 8 AS INT) AS r0, CAST(col // 8 AS INT) AS c0, count(*) AS size, degrees(atan2(sum(sin(radians(aspect))) FILTER (aspect >= 0), sum(cos(radians(aspect))) FILTER (aspect >= 0))) AS a FROM sl GROUP BY 1, 2)
SELECT r0, c0, size, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 4) AS facing FROM x""")
def a30_facets(spark, d):
    sl = grid.slope_aspect(b.cells(spark, d), "z", 100.0).withColumns({"r0": F.floor(F.col("row") / 8).cast("int"), "c0": F.floor(F.col("col") / 8).cast("int")})
    return b.rounded(tables.facet_facts(sl, ["r0", "c0"], "aspect"), 4)


@query(f"WITH {b.DD} SELECT fid, day, round(list_avg([obs, top, low, base]), 6) AS mean, round(least(obs, top, low, base), 6) AS low, round(greatest(obs, top, low, base) - least(obs, top, low, base), 6) AS range, round(list_stddev_pop([obs, top, low, base]), 5) AS sd FROM dd", dates=("day",))
def a31_row_stats(spark, d):
    s = tables.row_stats(["obs", "top", "low", "base"])
    return b.daily_obs(spark, d).select("fid", "day", *[F.round(x, 5 if n == "sd" else 6).alias(n) for n, x in s.items()])


@query(f"WITH {b.DD}, p AS (SELECT fid, avg(delta) AS p FROM dd GROUP BY 1) SELECT day, count(*) AS n, round(avg(abs(delta - p)), 6) AS mae, round(avg(abs(delta)), 6) AS zero FROM dd JOIN p ON p.fid = dd.fid WHERE dd.fid % 10 = 0 GROUP BY 1", dates=("day",))
def a43_centre_error(spark, d):
    """Errors at held-out centre stations, once a station-day, beside those of no correction."""
    o = b.daily_obs(spark, d)
    p = o.groupBy("fid").agg(F.avg("delta").alias("p"))
    x = o.where("fid % 10 = 0").dropDuplicates(["fid", "day"]).join(p, "fid")
    return b.rounded(x.groupBy("day").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("delta") - F.col("p"))).alias("mae"), F.avg(F.abs("delta")).alias("zero")))


@query(f"WITH {b.SE} SELECT channel, count(b) AS n, round(avg(b), 5) AS mean, round(stddev_pop(b), 5) AS sd FROM se WHERE k % 10 = 0 AND b > 0 GROUP BY 1")
def a44_sampled_stats(spark, d):
    return b.rounded(tables.one_pass(b.sensors(spark, d).where("k % 10 = 0 and b > 0"), ["channel"], "b"), 5)


@query(f"WITH {b.DD} SELECT fid, day, round(obs, 6) AS obs FROM dd ORDER BY fid, day", dates=("day",))
def s01_sorted(spark, d):
    return b.rounded(b.daily_obs(spark, d).select("fid", "day", "obs").orderBy("fid", "day"))


@query("WITH x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CASE WHEN year(o_orderdate) IN (1993, 1994) THEN 'train' WHEN year(o_orderdate) = 1996 THEN 'val' END AS split FROM orders) SELECT k, day, split FROM x WHERE split IS NOT NULL AND day IN (SELECT day FROM x WHERE k % 3 = 0 AND split IS NOT NULL)", dates=("day",))
def s05_year_split(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    return tables.year_split(o, "day", [1993, 1994], [1996], F.col("k") % 3 == 0)


@query(f"WITH {b.ST} SELECT fid, lat >= 43 AND lat <= 45 AND lon >= -120 AND lon <= -110 AS held FROM st")
def s07_box_holdout(spark, d):
    s = b.stations(spark, d)
    box = qc.inside(s, -120, 43, -110, 45, True).select("fid", F.lit(True).alias("in"))
    return s.select("fid").join(box, "fid", "left").select("fid", F.coalesce("in", F.lit(False)).alias("held"))


@query(f"WITH {b.DD}, x AS (SELECT fid, day, obs, fid * 31 + {DAYNO} AS k FROM dd) SELECT fid, day, round(CASE WHEN {H('k', 12)} < 10000 THEN 0 ELSE obs END, 6) AS obs, {H('k', 12)} < 10000 AS zeroed FROM x WHERE {H('k', 11)} >= 20000", dates=("day",))
def s16_gaps(spark, d):
    o = b.daily_obs(spark, d)
    out = tables.with_gaps(o, F.col("fid") * 31 + dayno(), 20000 / 100003, 10000 / 100003, 11)
    return b.rounded(out.select("fid", "day", F.when(F.col("zeroed"), 0.0).otherwise(F.col("obs")).alias("obs"), "zeroed"))


@query(f"WITH {b.ST} SELECT fid, name, CAST(NULL AS DOUBLE) AS elev FROM st WHERE fid % 3 = 0 UNION ALL SELECT fid, NULL, elev FROM st WHERE fid % 3 = 1 UNION ALL SELECT fid, name, elev FROM st WHERE fid % 3 = 2")
def u01_by_name(spark, d):
    s = b.stations(spark, d)
    part = lambda n, *c: s.where(F.col("fid") % 3 == n).select("fid", *c)
    return part(0, "name").unionByName(part(1, "elev"), allowMissingColumns=True).unionByName(part(2, "elev", "name"))


@query("SELECT c_custkey AS fid FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events")
def u02_all_ids(spark, d):
    names = (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))
    a, z, y = (b.table(spark, d, t).select(F.col(c).cast("long").alias("fid")) for t, c in names)
    return a.unionByName(z).unionByName(y).distinct()


@query(f"WITH {b.EV}, x AS (SELECT *, radians((event_id * 7) % 360) AS a, tan(radians(event_id % 40)) AS s FROM ev) SELECT event_id, round(-(u * sin(a) + v * cos(a)) * s, 6) AS upslope, round((u * cos(a) - v * sin(a)) * s, 6) AS across, sqrt(u * u + v * v) < 1 AS calm FROM x")
def f21_flow_terrain(spark, d):
    k = F.col("event_id")
    up, across, calm = tables.flow_terrain(F.col("u"), F.col("v"), (k % 40).cast("double"), ((k * 7) % 360).cast("double"))
    return b.rounded(b.hourly(spark, d).select("event_id", up.alias("upslope"), across.alias("across"), calm.alias("calm")))


@query("SELECT o_orderkey AS k, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1992-01-01' AND DATE '1993-12-31' THEN 'v1' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-06-30' THEN 'v2' END AS version FROM orders")
def f30_versions(spark, d):
    table = [("v1", "1992-01-01", "1993-12-31"), ("v2", "1994-01-01", "1996-06-30")]
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), tables.in_range(F.to_date("o_orderdate"), table).alias("version"))


@query(f"""WITH {b.GR}, m AS (SELECT a.row, a.col, any_value(a.z) AS z, min(q.z) AS lo FROM gr a JOIN gr q ON {D2} <= 4 GROUP BY 1, 2),
n AS (SELECT a.row, a.col, any_value(a.z) - avg(q.lo) AS up FROM m a JOIN m q ON {D2} <= 1 GROUP BY 1, 2) SELECT a.row, a.col, round(avg(q.up), 6) AS height FROM n a JOIN n q ON {D2} <= 4 GROUP BY 1, 2""")
def g05_effective_height(spark, d):
    return b.rounded(tables.effective_height(b.cells(spark, d), "z", 2, 1, 2))


W6 = f"(1 / sqrt(greatest({D2}, 0.25)))"


@query(f"WITH {b.GR}, x AS (SELECT a.row, a.col, sum({W6} * q.z) / sum({W6}) AS m FROM gr a JOIN gr q ON {D2} <= 16 GROUP BY 1, 2) SELECT row, col, round(least(greatest((m - 900) / 600, 0), 1), 6) AS areal FROM x")
def g06_areal_index(spark, d):
    return b.rounded(tables.areal_index(b.cells(spark, d), "z", 4, (900.0, 1500.0)))


@query(f"""WITH {b.GR}, t AS (SELECT *, CAST(row // 8 * 100 + col // 8 AS INT) AS tile FROM gr), f AS (SELECT a.row, a.col, any_value(a.tile) AS tile, any_value(a.z) AS z, sum(q.z / (1 + {D2})) / sum(1 / (1 + {D2})) AS m FROM t a JOIN t q ON {D2} <= 1 GROUP BY 1, 2),
s AS (SELECT a.row, a.col, min(sqrt({D2})) AS gap FROM t a JOIN t q ON {D2} <= 9 AND a.tile <> q.tile GROUP BY 1, 2), x AS (SELECT f.*, least(coalesce(gap, 3) / 3, 1) AS al FROM f LEFT JOIN s ON s.row = f.row AND s.col = f.col)
SELECT row, col, tile, round(al * z + (1 - al) * m, 6) AS z FROM x""")
def g09_feathered(spark, d):
    tile = (F.floor(F.col("row") / 8) * 100 + F.floor(F.col("col") / 8)).cast("int")
    t = b.cells(spark, d).withColumn("tile", tile)
    return b.rounded(tables.feathered(t, "z", "tile", grid.disc(1, lambda d2: 1 / (1 + d2)), 3))


@query(f"WITH {b.GR}, x AS (SELECT row, col, k, CASE WHEN z BETWEEN 900 AND 1500 THEN greatest((z - 1000) * 0.0001, 0) END AS v FROM gr) SELECT row, col, round(v, 6) AS v, CAST(k & 3 AS INT) AS cloud, v IS NULL AS miss FROM x")
def g19_satellite_cells(spark, d):
    c = b.cells(spark, d).withColumn("v", F.col("z") - 1000)
    out = tables.clear_pixels(c, "v", "k", -100, 500, 1e-4)
    return b.rounded(out.select("row", "col", "v", F.col("cloud").cast("int").alias("cloud"), "miss"))


@query(f"WITH {b.ST}, {b.GR} SELECT fid, gr.row, gr.col, round(CASE WHEN z BETWEEN 900 AND 1500 THEN z * 0.1 END, 6) AS v, CAST(k & 3 AS INT) AS cloud, NOT (z BETWEEN 900 AND 1500) AS miss FROM st JOIN gr ON gr.row = CAST(elev AS INT) % 4 AND gr.col = fid % 50")
def src21_pixels(spark, d):
    c = tables.clear_pixels(b.cells(spark, d).withColumnRenamed("z", "v"), "v", "k", 900, 1500, 0.1)
    s = b.stations(spark, d).select("fid", "elev")
    out = tables.at_cells(s, c, F.col("elev").cast("int") % 4, (F.col("fid") % 50).cast("int"), (4, 50))
    return b.rounded(out.select("fid", "row", "col", "v", F.col("cloud").cast("int").alias("cloud"), "miss"))


@query(f"WITH {SLOPE}, {b.ST}, tp AS ({SQL['g02_position_index']}) SELECT fid, round(slope, 4) AS slope, round(aspect, 4) AS aspect, round(tpi, 4) AS tpi FROM st JOIN sl ON sl.row = CAST(elev AS INT) % 4 AND sl.col = fid % 50 JOIN tp ON tp.row = sl.row AND tp.col = sl.col")
def g21_terrain_at_points(spark, d):
    t = grid.slope_aspect(b.cells(spark, d), "z", 100.0).join(QUERIES["g02_position_index"](spark, d), ["row", "col"])
    out = tables.at_cells(b.stations(spark, d).select("fid", "elev"), t, F.col("elev").cast("int") % 4, (F.col("fid") % 50).cast("int"), (4, 50))
    return b.rounded(out.select("fid", "slope", "aspect", "tpi"), 4)


@query(f"WITH {b.ST}, {NB} SELECT count(*) AS edges, count(*) FILTER (src = dst) AS loops, count(*) FILTER (km > 100) AS far, count(*) FILTER (dst % 7 = 0) AS unknown, CAST(0 AS BIGINT) AS repeated FROM nb WHERE rank <= 4")
def g22_graph_checks(spark, d):
    s = b.stations(spark, d)
    return tables.graph_checks(spatial.neighbours(s, s, 4, 150.0), s.where("fid % 7 <> 0"), 100.0)


def nodes(spark, d, transductive):
    o = tables.with_static(b.daily_obs(spark, d), b.stations(spark, d).select("fid", "elev", "lat"), "fid")
    sin, cos = geo.season(F.col("day"))
    o = o.withColumns({"sin": sin, "cos": cos})
    names = ["base", "top", "elev", "sin", "cos", "delta"]
    held = b.stations(spark, d).where("fid % 10 = 0").select("fid")
    out = tables.node_table(o, names, ["obs"], held, transductive, ["delta"])
    return b.rounded(out.select("day", "fid", *[F.get("features", F.lit(i)).alias(f"x_{n}") for i, n in enumerate(names)], "obs", "loss"), 5)


NODE = """SELECT day, dd.fid, round(coalesce(base, 0), 5) AS x_base, round(coalesce(top, 0), 5) AS x_top, coalesce(elev, 0) AS x_elev, round(sin(2 * pi() * dayofyear(day) / 365.25), 5) AS x_sin,
 round(cos(2 * pi() * dayofyear(day) / 365.25), 5) AS x_cos, round(CASE WHEN {held} THEN 0 ELSE coalesce(delta, 0) END, 5) AS x_delta, round(obs, 5) AS obs, obs IS NOT NULL AND NOT ({held}) AS loss FROM dd LEFT JOIN st ON st.fid = dd.fid"""
HELD = "dd.fid % 10 = 0 AND dd.fid IN (SELECT fid FROM st)"


@query(f"WITH {b.DD}, {b.ST} {NODE.format(held=HELD)}", dates=("day",))
def gr04_transductive(spark, d):
    return nodes(spark, d, True)


@query(f"WITH {b.DD}, {b.ST} {NODE.format(held=HELD)} WHERE NOT ({HELD})", dates=("day",))
def gr04_inductive(spark, d):
    return nodes(spark, d, False)


@query(f"""WITH {b.ST}, {NB}, e AS (SELECT min(elev) AS lo, max(elev) AS hi, min(bal) AS lb, max(bal) AS hb FROM st WHERE fid % 10 <> 0)
SELECT nb.src, nb.dst, round(km, 5) AS km, round((s.elev - t.elev) / (hi - lo), 5) AS d_elev, round((s.bal - t.bal) / (hb - lb), 5) AS d_bal FROM nb JOIN st s ON s.fid = nb.src JOIN st t ON t.fid = nb.dst CROSS JOIN e WHERE rank <= 4""")
def gr03_station_graph(spark, d):
    s = b.stations(spark, d)
    e = spatial.neighbours(s, s, 4, 150.0).select("src", "dst", "km")
    return b.rounded(tables.station_graph(e, s.select("fid", "elev", "bal"), ["elev", "bal"], s.where("fid % 10 <> 0").select("fid")), 5)


@query(f"WITH {b.DD} SELECT fid, day, coalesce(obs + delta / 10 - low > 2 AND NOT (n > 1 AND fid % 4 = 0), false) AS bad FROM dd", dates=("day",))
def q03_dew_over_minimum(spark, d):
    wet = (F.col("n") > 1) & (F.col("fid") % 4 == 0)
    return b.daily_obs(spark, d).select("fid", "day", tables.dew_over_minimum(F.col("obs") + F.col("delta") / 10, F.col("low"), wet).alias("bad"))


@query("""WITH x AS (SELECT l_suppkey AS fid, year(l_shipdate) AS year, l_quantity AS rh FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY fid, year ORDER BY rh) AS r, count(*) OVER (PARTITION BY fid, year) AS n FROM x)
SELECT fid, CAST(year AS INT) AS year, rh AS p99, n, round(100 / rh, 6) AS factor FROM r WHERE r = ceil(0.99 * n)""")
def q02_humidity_drift(spark, d):
    l = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fid"), "l_shipdate", F.col("l_quantity").alias("rh"))
    return b.rounded(tables.humidity_drift(l, "fid", F.year("l_shipdate"), "rh"))


@query(f"""WITH {b.EV}, p AS (SELECT event_type AS provider, count(*) AS weight FROM ev GROUP BY 1) SELECT 's' || fid AS station, event_id AS id, weight, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS wind, '' AS note
FROM ev JOIN p ON p.provider = ev.event_type WHERE value BETWEEN 10 AND 60 AND event_id % 7 <> 0""")
def src13_hourly_network(spark, d):
    h = b.hourly(spark, d)
    p = h.groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("weight"))
    station = F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.concat(F.lit("s"), F.col("fid").cast("string")))
    rows = h.select(station.alias("station"), F.col("event_id").alias("id"), F.col("event_type").alias("provider"), "value")
    columns = {"station": "string", "id": "long", "weight": "long", "value": "double", "wind": "double", "note": "string"}
    return b.rounded(tables.hourly_network(rows, p, columns, F.col("value").between(10, 60)))


@query(f"""WITH {b.EV}, k AS (SELECT fid, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ev GROUP BY fid), w AS (SELECT fid, day, arg_min(value, event_id) FILTER (event_id % 2 = 0) AS a, arg_min(value, event_id) FILTER (event_id % 2 = 1) AS b FROM ev GROUP BY 1, 2)
SELECT k.fid, k.day, round(a, 6) AS a, round(b, 6) AS b, count(a) OVER (PARTITION BY k.fid) AS n_a, count(b) OVER (PARTITION BY k.fid) AS n_b FROM k LEFT JOIN w ON w.fid = k.fid AND w.day = k.day""", dates=("day",))
def src15_sites_daily(spark, d):
    h = b.hourly(spark, d).select("fid", "day", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("parameter"), "value", F.col("event_id").alias("at"))
    return b.rounded(tables.sites_daily(h, series.spine(h, "fid"), ["a", "b"]))


@query(f"WITH {b.DD} SELECT fid, day, round(obs, 6) AS tmax_prism, round(low, 6) AS tmin_prism FROM dd", dates=("day",))
def src22_contract(spark, d):
    return b.rounded(tables.canonical(b.daily_obs(spark, d).select("fid", "day", "obs", "low"), {"tmax": ["obs"], "tmin": ["low"], "rain": ["ppt"]}, "prism"))


@query(f"WITH {b.ST} SELECT fid, round(CASE WHEN degrees(atan2(sin(radians(-117 - lon)) * cos(radians(45)), cos(radians(lat)) * sin(radians(45)) - sin(radians(lat)) * cos(radians(45)) * cos(radians(-117 - lon)))) < 0 THEN 360 ELSE 0 END + degrees(atan2(sin(radians(-117 - lon)) * cos(radians(45)), cos(radians(lat)) * sin(radians(45)) - sin(radians(lat)) * cos(radians(45)) * cos(radians(-117 - lon)))), 5) AS deg FROM st")
def f11_bearing(spark, d):
    s = b.stations(spark, d)
    return s.select("fid", F.round(geo.bearing_degrees(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(-117.0)), 5).alias("deg"))


@query(f"WITH {b.EV} SELECT event_id, round(CASE WHEN sqrt(u * u + v * v) * 5 > 1e-8 THEN (u * 3 + v * 4) / (sqrt(u * u + v * v) * 5) ELSE 0 END, 6) AS cosine FROM ev")
def f13_facet_alignment(spark, d):
    return b.rounded(b.hourly(spark, d).select("event_id", geo.facet_alignment(F.col("u"), F.col("v"), F.lit(3.0), F.lit(4.0)).alias("cosine")))


@query("SELECT o_orderkey AS k, CAST(dayofyear(o_orderdate) - CASE WHEN dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 AND dayofyear(o_orderdate) > 60 THEN 1 ELSE 0 END AS INT) AS doy FROM orders")
def f15_doy365(spark, d):
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), geo.doy365(F.to_date("o_orderdate")).alias("doy"))


@query(f"WITH {b.DD} SELECT fid, day, round(CASE WHEN obs BETWEEN 10 AND 60 THEN obs END, 6) AS obs, round(top, 6) AS top FROM dd", dates=("day",))
def p12_limited(spark, d):
    return b.rounded(qc.limited(b.daily_obs(spark, d).select("fid", "day", "obs", "top"), {"obs": (10, 60), "top": None}))
