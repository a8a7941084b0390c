"""Aggregations, series, spatial joins, splits, statistics, grids and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, series, spatial, stats
from ..shared import shared_dir, shuffled
from . import bindings as b
from .queries_rows import HAV
from .registry import query

NB = f"""nb AS (SELECT src, dst, km, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rank FROM
 (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON a.fid <> z.fid) WHERE km <= 150)"""
H = lambda key, seed: f"(({key}) * 7919 + {seed}) % 100003"


@query(f"""WITH {b.EV}, k AS (SELECT fid, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM ev GROUP BY fid),
a AS (SELECT fid, day, avg(value) AS m, max(value) AS x, sum(u) AS s, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT k.fid, CAST(k.day AS DATE) AS day, round(m, 6) AS value_mean, round(x, 6) AS value_max, round(coalesce(s, 0), 6) AS u_sum, coalesce(n, 0) AS n_hours FROM k LEFT JOIN a ON a.fid = k.fid AND a.day = k.day""", dates=("day",))
def a01_daily_on_spine(spark, d):
    return b.rounded(series.daily(b.hourly(spark, d), "fid", "ts", mean=["value"], top=["value"], total=["u"]))


@query(f"""WITH {b.EV}, x AS (SELECT fid, day, avg(sqrt(u * u + v * v)) AS wind, degrees(atan2(-avg(u), -avg(v))) AS a, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT fid, day, round(wind, 6) AS wind, n AS n_hours, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 4) AS wdir FROM x""", dates=("day",))
def a02_vector_wind(spark, d):
    out = series.vector_daily(b.hourly(spark, d), "fid", "ts", "u", "v")
    return out.select("fid", "day", F.round("wind", 6).alias("wind"), "n_hours", F.round("wdir", 4).alias("wdir"))


@query(f"""WITH {b.EV}, h AS (SELECT fid, date_trunc('hour', ts - INTERVAL 7 HOUR) AS hour, avg(value) AS v FROM ev GROUP BY 1, 2)
SELECT fid, CAST(hour AS DATE) AS day, round(avg(v), 6) AS mean, round(max(v), 6) AS top, round(min(v), 6) AS low, count(v) AS hours FROM h GROUP BY 1, 2 HAVING count(v) >= 2""", dates=("day",))
def a05_local_days(spark, d):
    return b.rounded(series.local_daily(b.hourly(spark, d), "fid", "ts", "-07:00", "value", 2))


@query("""WITH t AS (SELECT l_orderkey AS fid, CAST(l_shipdate AS DATE) AS day, l_linenumber AS code, sum(l_quantity - 10) AS t FROM lineitem GROUP BY 1, 2, 3)
SELECT fid, day, round(arg_min(t, list_position([3, 2, 1, 5], code)), 6) AS total, arg_min(code, list_position([3, 2, 1, 5], code)) AS code FROM t WHERE code IN (3, 2, 1, 5) AND t >= 0 GROUP BY 1, 2""", dates=("day",))
def a06_priority_rain(spark, d):
    l = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fid"), F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("code"), (F.col("l_quantity") - 10).alias("x"))
    return b.rounded(series.priority_rain(l, "fid", "day", "code", "x", [3, 2, 1, 5]))


@query(f"""WITH {b.EV} SELECT fid, day, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN bool_or(hour(ts) BETWEEN 0 AND 8) THEN min(value) END, 6) AS tmin,
 round(CASE WHEN bool_or(hour(ts) BETWEEN 12 AND 18) THEN max(value) END, 6) AS tmax FROM ev GROUP BY 1, 2 HAVING count(value) >= 3""", dates=("day",))
def a07_gated_days(spark, d):
    return b.rounded(series.gated(b.hourly(spark, d), "fid", "ts", "value", 3))


@query(f"""WITH {b.EV} SELECT fid, day, round(avg(value) FILTER (hour(ts) = 0), 6) AS value_00, round(avg(value) FILTER (hour(ts) = 12), 6) AS value_12, round(max(value), 6) AS top,
 round(min(value), 6) AS low, count(DISTINCT hour(ts)) AS n_hours FROM ev GROUP BY 1, 2""", dates=("day",))
def a09_hour_wide(spark, d):
    return b.rounded(series.hour_wide(b.hourly(spark, d), "fid", "ts", "value", [0, 12]))


@query(f"WITH {b.EV} SELECT fid, count(*) AS n, count(DISTINCT day) AS days, min(day) AS a, max(day) AS z, round(min(value), 6) AS low, round(max(value), 6) AS top FROM ev GROUP BY 1", dates=("a", "z"))
def a10_record_assessment(spark, d):
    g = b.hourly(spark, d).groupBy("fid")
    return b.rounded(g.agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.min("day").alias("a"), F.max("day").alias("z"), F.min("value").alias("low"), F.max("value").alias("top")))


@query("""SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a11_counts_pivoted(spark, d):
    o = b.table(spark, d, "orders").join(b.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@query("""WITH x AS (SELECT o_custkey AS fid, dayofyear(o_orderdate) AS n, year(o_orderdate) AS y, day(last_day(make_date(year(o_orderdate), 2, 1))) = 29 AS leap, o_totalprice AS v FROM orders)
SELECT n - CASE WHEN leap AND n > 60 THEN 1 ELSE 0 END AS doy, round(sum(v), 2) AS v, count(*) AS n, count(DISTINCT y) AS years FROM x GROUP BY 1""")
def a14_doy_means(spark, d):
    from ..functions.geo import doy365

    o = b.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return b.rounded(o.groupBy(doy365(F.col("day")).alias("doy")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"), F.count_distinct(F.year("day")).alias("years")), 2)


@query("""SELECT col, round(avg(x), 6) AS mean, round(greatest(stddev_samp(x), 1e-8), 6) AS std FROM (SELECT 'l_quantity' AS col, l_quantity AS x, l_orderkey AS k FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_orderkey FROM lineitem) WHERE k % 10 <> 0 GROUP BY 1""")
def a16_norm_stats(spark, d):
    return b.rounded(stats.norm_stats(b.table(spark, d, "lineitem"), ["l_quantity", "l_discount"], F.col("l_orderkey") % 10 != 0))


@query("""SELECT col, round(min(x) FILTER (ok), 6) AS bias, round(max(x) FILTER (ok) - min(x) FILTER (ok), 6) AS scale, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS invalid
FROM (SELECT 'l_quantity' AS col, l_quantity AS x, l_quantity BETWEEN 5 AND 45 AS ok FROM lineitem UNION ALL SELECT 'l_tax', l_tax, true FROM lineitem) GROUP BY 1""")
def a18_min_max_scaler(spark, d):
    return b.rounded(stats.min_max(b.table(spark, d, "lineitem"), ["l_quantity", "l_tax"], {"l_quantity": (5, 45)}))


@query(f"""WITH {b.SE}, q AS (SELECT channel, quantile_cont(a, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS xs, quantile_cont(b, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS ys, count(*) AS n FROM se GROUP BY 1)
SELECT channel, i, round(xs[i + 1], 6) AS x, round(ys[i + 1], 6) AS y, n FROM q, range(11) t(i)""")
def a19_breakpoints(spark, d):
    q = stats.breakpoints(b.sensors(spark, d), ["channel"], "a", "b", 11)
    q = q.select("channel", "n", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    return b.rounded(q.select("channel", F.col("i").cast("long").alias("i"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), "n"))


@query(f"""WITH {b.SE}, s AS (SELECT channel, avg(a) AS mx, stddev_samp(a) AS sx, avg(b) AS my, stddev_samp(b) AS sy FROM se WHERE k % 2 = 0 GROUP BY 1)
SELECT k, line, round(a, 6) AS a, round((a - mx) * sy / nullif(sx, 0) + my, 6) AS fixed FROM se JOIN s ON s.channel = se.channel""")
def a36_cross_calibration(spark, d):
    out = stats.cross_calibrated(b.sensors(spark, d), ["channel"], "a", "b", F.col("k") % 2 == 0, "fixed")
    return b.rounded(out.select("k", "line", "a", "fixed"))


@query(f"""WITH {b.DD} SELECT fid, round(avg(base - obs), 6) AS bias, round(avg(abs(base - obs)), 6) AS mae, round(sqrt(avg((base - obs) * (base - obs))), 6) AS rmse,
 round(1 - sum((base - obs) * (base - obs)) / nullif(var_pop(obs) * count(*), 0), 5) AS r2, count(*) AS n FROM dd GROUP BY 1 HAVING count(*) >= 2""")
def a23_skill(spark, d):
    out = stats.skill(b.daily_obs(spark, d), ["fid"], "obs", "base", 2)
    return b.rounded(out.withColumn("r2", F.round("r2", 5)))


@query(f"""WITH {b.EV} SELECT event_type, round(avg(abs(0.9 * u - u)), 6) AS par_mae, round(avg(abs(0.8 * v - v)), 6) AS perp_mae, round(sqrt(avg(pow(0.9 * u - u, 2) + pow(0.8 * v - v, 2))), 6) AS vector_rmse,
 round(100 * (1 - sqrt(avg(pow(0.9 * u - u, 2) + pow(0.8 * v - v, 2))) / nullif(sqrt(avg(u * u + v * v)), 0)), 6) AS gain FROM ev GROUP BY 1""")
def a25_wind_skill(spark, d):
    e = b.hourly(spark, d).withColumns({"pu": 0.9 * F.col("u"), "pv": 0.8 * F.col("v")})
    return b.rounded(stats.wind_skill(e, ["event_type"], "u", "v", "pu", "pv"))


@query(f"""WITH {b.DD}, m AS (SELECT quantile_cont(delta, 0.5) AS m FROM dd WHERE fid % 10 <> 0) SELECT 'delta' AS col, round(greatest(1.4826 * quantile_cont(abs(delta - m), 0.5), 1e-6), 6) AS scale FROM dd, m WHERE fid % 10 <> 0""")
def a27_robust_scale(spark, d):
    return b.rounded(stats.robust_scale(b.daily_obs(spark, d), ["delta"], F.col("fid") % 10 != 0))


@query("""WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM x GROUP BY 1, 2""")
def a32_embedding_means(spark, d):
    m = stats.embedding_means(b.vectors(spark, d), ["label"], "vec").select("label", F.posexplode("vec").alias("i", "x"))
    return b.rounded(m.withColumn("i", F.col("i").cast("long")))


@query(f"""WITH {b.DD}, {b.ST}, {NB}, s AS (SELECT * FROM dd WHERE fid % 10 <> 0), i AS (SELECT src AS fid, s.day, avg(delta) AS m, stddev_pop(delta) AS sd, count(delta) AS n FROM nb JOIN s ON s.fid = nb.dst WHERE rank <= 16 GROUP BY 1, 2)
SELECT dd.fid, dd.day, round(delta, 6) AS delta, round(m, 6) AS inn_delta_mean, round(sd, 6) AS inn_delta_std, coalesce(i.n, 0) AS inn_delta_n FROM dd LEFT JOIN i ON i.fid = dd.fid AND i.day = dd.day""", dates=("day",))
def flagship_residuals(spark, d):
    """Observations to days, residuals against the day's baseline, neighbours' innovations without holdout."""
    s = b.stations(spark, d)
    edges = spatial.neighbours(s, s, 16, 150.0)
    table = b.daily_obs(spark, d).select("fid", "day", "delta")
    out = stats.innovations(table, edges, s.where(F.col("fid") % 10 == 0).select("fid"), ["delta"])
    return b.rounded(out)


@query(f"WITH {b.ST}, {NB} SELECT src, dst, rank, round(km, 6) AS km FROM nb WHERE rank <= 16")
def j11_knn_graph(spark, d):
    s = b.stations(spark, d)
    return b.rounded(spatial.neighbours(s, s, 16, 150.0).select("src", "dst", "rank", "km"))


@query(f"""WITH {b.ST}, x AS (SELECT src, dst, km, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rank FROM (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON z.fid % 10 <> 0) WHERE km <= 80)
SELECT src, dst, rank, round(km, 6) AS km FROM x WHERE rank <= 5 AND src <> dst""")
def j13_bipartite(spark, d):
    s = b.stations(spark, d)
    return b.rounded(spatial.neighbours_then_filter(s, s.where(F.col("fid") % 10 != 0), 5, 80.0).select("src", "dst", "rank", "km"))


@query(f"""WITH {b.ST}, x AS (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON z.fid % 97 = 0)
SELECT src, arg_min(dst, (km, dst)) AS dst, round(min(km), 6) AS km FROM x GROUP BY 1""")
def j18_nearest_all(spark, d):
    """The nearest point of a thin grid for every station."""
    s = b.stations(spark, d)
    return b.rounded(spatial.nearest(s, s.where(F.col("fid") % 97 == 0)).select("src", "dst", "km"))


@query(f"""WITH {b.DD}, {b.ST}, p AS (SELECT dd.fid, dd.day, lat, lon, elev, delta AS y FROM dd JOIN st ON st.fid = dd.fid),
e AS (SELECT day, src, dst, km, row_number() OVER (PARTITION BY day, src ORDER BY km, dst) AS r FROM (SELECT a.day, a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM p a JOIN p z ON a.day = z.day AND a.fid <> z.fid) WHERE km <= 120),
q AS (SELECT DISTINCT day, least(src, dst) AS i, greatest(src, dst) AS j, km FROM e WHERE r <= 8)
SELECT q.day, i, j, round(min(km), 5) AS km, min(a.elev - z.elev) AS dz, round(min(a.y - z.y), 6) AS dy FROM q JOIN p a ON a.day = q.day AND a.fid = i JOIN p z ON z.day = q.day AND z.fid = j GROUP BY 1, 2, 3""", dates=("day",))
def j20_pairs(spark, d):
    p = b.daily_obs(spark, d).join(shuffled(b.stations(spark, d)), "fid").select("fid", "day", "lat", "lon", "elev", F.col("delta").alias("y"))
    out = spatial.pairs(p, 8, 120.0)
    return out.select("day", "i", "j", F.round("km", 5).alias("km"), "dz", F.round("dy", 6).alias("dy"))


@query(f"""WITH {b.ST}, {NB}, c AS (SELECT * FROM nb WHERE km >= 20), n AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY km, src) AS r FROM c) SELECT src, dst, round(km, 6) AS km, r AS rank FROM n WHERE r <= 4""")
def j23_pruned(spark, d):
    s = b.stations(spark, d)
    return b.rounded(spatial.pruned(s, 20.0, 150.0, 4))


@query(f"""WITH {b.ST} SELECT fid FROM st a WHERE NOT EXISTS (SELECT 1 FROM st z WHERE z.fid % 20 = 1 AND {HAV.format(a='a', d='z')} <= 60)""")
def j24_not_near_all(spark, d):
    """All stations but those near a query point."""
    s = b.stations(spark, d)
    return spatial.not_near(s, s.where(F.col("fid") % 20 == 1), 60.0).select("fid")


@query(f"""WITH {b.GR} SELECT a.row, a.col, z.row AS row2, z.col AS col2, round(z.z - a.z, 6) AS dz FROM gr a JOIN gr z ON abs(a.row - z.row) + abs(a.col - z.col) = 1""")
def j25_grid_edges(spark, d):
    g = b.cells(spark, d)
    e = grid.adjacency(g, values=["z"])
    return b.rounded(e.select("row", "col", "row2", "col2", (F.col("z2") - F.col("z")).alias("dz")))


@query(f"""WITH {b.DD} SELECT fid, day, round(max(obs) OVER (PARTITION BY fid ORDER BY day ROWS 14 PRECEDING), 6) AS top15, round(obs - lag(obs) OVER (PARTITION BY fid ORDER BY day), 6) AS step FROM dd""", dates=("day",))
def w01_rolling(spark, d):
    x = series.rolling_max(b.daily_obs(spark, d).select("fid", "day", "obs"), "fid", "day", "obs", 15, "top15")
    return b.rounded(series.difference(x, ["fid"], "day", "obs", "step").drop("obs"))


@query(f"""WITH {b.DD}, k AS (SELECT fid, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dd GROUP BY fid), x AS (SELECT k.fid, k.day, obs FROM k LEFT JOIN dd ON dd.fid = k.fid AND dd.day = k.day)
SELECT fid, day, round(coalesce(last_value(obs IGNORE NULLS) OVER (PARTITION BY fid ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(obs IGNORE NULLS) OVER (PARTITION BY fid ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS obs FROM x""", dates=("day",))
def w03_fill(spark, d):
    x = series.on_spine(b.daily_obs(spark, d).select("fid", "day", "obs"), "fid")
    return b.rounded(series.fill(x, "fid", "day", "obs"))


@query(f"""WITH {b.DD}, k AS (SELECT fid, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dd GROUP BY fid), x AS (SELECT k.fid, k.day, obs, row_number() OVER (PARTITION BY k.fid ORDER BY k.day) AS i FROM k LEFT JOIN dd ON dd.fid = k.fid AND dd.day = k.day),
y AS (SELECT *, last_value(CASE WHEN obs IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, last_value(obs IGNORE NULLS) OVER p AS va, first_value(CASE WHEN obs IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib, first_value(obs IGNORE NULLS) OVER f AS vb FROM x
 WINDOW p AS (PARTITION BY fid ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY fid ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT fid, day, round(CASE WHEN obs IS NOT NULL THEN obs WHEN ib IS NULL THEN va ELSE va + (vb - va) * (i - ia) / (ib - ia) END, 6) AS obs FROM y""", dates=("day",))
def w04_interpolate(spark, d):
    x = series.on_spine(b.daily_obs(spark, d).select("fid", "day", "obs"), "fid")
    return b.rounded(series.interpolate(x, "fid", "day", "obs"))


@query(f"""WITH {b.DD}, x AS (SELECT fid, day, day - CAST(row_number() OVER (PARTITION BY fid ORDER BY day) AS INT) AS g FROM dd), y AS (SELECT fid, day, row_number() OVER (PARTITION BY fid, g ORDER BY day) AS p FROM x)
SELECT fid, day - 3 AS start, day AS "end" FROM y WHERE p >= 4""", dates=("start", '"end"'))
def w05_runs(spark, d):
    return series.runs(b.daily_obs(spark, d), "fid", "day", 4)


@query(f"""WITH {b.DD}, k AS (SELECT fid, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dd GROUP BY fid), x AS (SELECT k.fid, k.day, obs, row_number() OVER (PARTITION BY k.fid ORDER BY k.day) - 1 AS i FROM k LEFT JOIN dd ON dd.fid = k.fid AND dd.day = k.day),
w AS (SELECT fid, win, min(day) AS start, count(*) AS n, count(obs) AS valid FROM x, range(20) t(win) WHERE i >= win * 5 AND i < win * 5 + 10 GROUP BY 1, 2) SELECT fid, CAST(win AS INT) AS win, start, valid FROM w WHERE n = 10 AND valid >= 8""", dates=("start",))
def w06_windows(spark, d):
    return series.windows(b.daily_obs(spark, d).select("fid", "day", "obs"), "fid", "day", "obs", 10, 5, 0.8)


@query("""WITH x AS (SELECT * FROM (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1) SELECT k, line, p FROM x""")
def w08_keep_last(spark, d):
    l = b.table(spark, d, "lineitem")
    out = series.one_of_each(l, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_extendedprice")])
    return out.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"))


@query(f"WITH {b.DD}, c AS (SELECT day, count(*) AS n FROM dd GROUP BY 1) SELECT day, CAST(sum(n) OVER (ORDER BY day) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS stop FROM c", dates=("day",))
def w09_day_slices(spark, d):
    return series.slices(b.daily_obs(spark, d), "day", ["fid"])


@query("""WITH x AS (SELECT dayofyear(o_orderdate) AS n, avg(o_totalprice) AS v FROM orders WHERE dayofyear(o_orderdate) <= 365 GROUP BY 1), o AS (SELECT CAST(i AS INT) - 8 AS o, exp(-0.5 * pow((i - 8) / 2.0, 2)) AS w FROM range(17) t(i))
SELECT (n + o.o - 1 + 365) % 365 + 1 AS doy, round(sum(w * v) / sum(w), 4) AS v FROM x, o GROUP BY 1""")
def w10_smooth_year(spark, d):
    o = b.table(spark, d, "orders").groupBy(F.dayofyear("o_orderdate").alias("doy")).agg(F.avg("o_totalprice").alias("v")).where("doy <= 365")
    return b.rounded(series.smooth_year(o, [], "doy", "v", 2.0), 4)


@query(f"WITH {b.ST}, x AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY {H('fid', 5)}, fid) AS r FROM st) SELECT nation, fid FROM x WHERE r <= 3")
def s03_sample_by_group(spark, d):
    return stats.first_by_hash(b.stations(spark, d), ["nation"], "fid", 3, 5).select("nation", "fid")


@query(f"WITH {b.ST}, x AS (SELECT fid, row_number() OVER (ORDER BY {H('fid', 11)}, fid) AS r, count(*) OVER () AS n FROM st) SELECT fid, CASE WHEN r <= round(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM x")
def s04_station_split(spark, d):
    return stats.station_split(b.stations(spark, d), 0.8, 11).select("fid", "split")


@query(f"""WITH {b.ST}, q AS (SELECT quantile_cont(elev, 0.25) AS a, quantile_cont(elev, 0.5) AS m, quantile_cont(elev, 0.75) AS z FROM st),
x AS (SELECT fid, CASE WHEN elev <= a THEN 0 WHEN elev <= m THEN 1 WHEN elev <= z THEN 2 ELSE 3 END AS stratum FROM st, q), y AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {H('fid', 3)}, fid) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM x)
SELECT fid, stratum FROM y WHERE r <= greatest(1, floor(n * 0.15 + 0.5))""")
def s06_elevation_holdout(spark, d):
    return stats.strata_holdout(b.stations(spark, d), "elev", 0.15, 3).select("fid", "stratum")


@query(f"""WITH {b.DD}, x AS (SELECT fid, day, fid % 10 = 0 AS held, {H("fid + date_diff('day', DATE '1970-01-01', day) * 31", 9)} AS h FROM dd), y AS (SELECT *, row_number() OVER (PARTITION BY day, held ORDER BY h, fid) AS r, count(*) OVER (PARTITION BY day, held) AS n FROM x)
SELECT fid, day, CASE WHEN held THEN 'holdout' WHEN n < 2 THEN 'source' WHEN r <= greatest(1, least(n - 1, floor(n * 0.7 + 0.5))) THEN 'source' ELSE 'query' END AS role FROM y""", dates=("day",))
def s08_source_query(spark, d):
    x = b.daily_obs(spark, d).select("fid", "day")
    return stats.source_query_split(x, x.where(F.col("fid") % 10 == 0), 0.7, 9)


@query(f"""WITH {b.GR}, o AS (SELECT a.i - 2 AS dr, c.i - 2 AS dc FROM range(5) a(i), range(5) c(i) WHERE (a.i - 2) * (a.i - 2) + (c.i - 2) * (c.i - 2) <= 4)
SELECT g.row, g.col, round(g.z, 6) AS z, round(avg(n.z), 6) AS z_focal FROM gr g JOIN o ON true JOIN gr n ON n.row = g.row + o.dr AND n.col = g.col + o.dc GROUP BY 1, 2, 3""")
def g03_focal_mean(spark, d):
    return b.rounded(grid.focal(b.cells(spark, d).drop("k"), grid.disc(2), "z"))


@query(f"""WITH {b.GR} SELECT g.row, g.col, round(avg(n.z), 6) AS z_wide FROM gr g JOIN gr n ON (n.row - g.row) * (n.row - g.row) + (n.col - g.col) * (n.col - g.col) <= 400 GROUP BY 1, 2""")
def g03_focal_wide(spark, d):
    """The mean over a disc of radius 20, 1,257 cells."""
    return b.rounded(grid.focal(b.cells(spark, d), grid.disc(20), "z").select("row", "col", F.col("z_focal").alias("z_wide")))


@query(f"""WITH {b.GR}, e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM gr), o AS (SELECT CAST(a.i AS INT) - 1 AS dr, CAST(c.i AS INT) - 1 AS dc FROM range(3) a(i), range(3) c(i)),
w AS (SELECT g.row, g.col, dr, dc, least(greatest(g.row + dr, r0), r1) AS r, least(greatest(g.col + dc, c0), c1) AS c FROM gr g, o, e), n AS (SELECT w.row, w.col, dr, dc, gr.z FROM w LEFT JOIN gr ON gr.row = r AND gr.col = c),
g AS (SELECT row, col, (max(z) FILTER (dr = -1 AND dc = 1) + 2 * max(z) FILTER (dr = 0 AND dc = 1) + max(z) FILTER (dr = 1 AND dc = 1) - max(z) FILTER (dr = -1 AND dc = -1) - 2 * max(z) FILTER (dr = 0 AND dc = -1) - max(z) FILTER (dr = 1 AND dc = -1)) / 800 AS dx,
 (max(z) FILTER (dr = 1 AND dc = -1) + 2 * max(z) FILTER (dr = 1 AND dc = 0) + max(z) FILTER (dr = 1 AND dc = 1) - max(z) FILTER (dr = -1 AND dc = -1) - 2 * max(z) FILTER (dr = -1 AND dc = 0) - max(z) FILTER (dr = -1 AND dc = 1)) / 800 AS dy FROM n GROUP BY 1, 2)
SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope, round(CASE WHEN sqrt(dx * dx + dy * dy) < 1e-12 THEN -1 WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 4) AS aspect FROM g""")
def g01_slope_aspect(spark, d):
    out = grid.slope_aspect(b.cells(spark, d), "z", 100.0)
    return out.select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"))


@query(f"""WITH {b.GR} SELECT g.row, g.col, round(g.z - avg(n.z), 6) AS tpi FROM gr g JOIN gr n ON abs(n.row - g.row) <= 3 AND abs(n.col - g.col) <= 3 GROUP BY g.row, g.col, g.z""")
def g02_position_index(spark, d):
    return b.rounded(grid.position_index(b.cells(spark, d).drop("k"), "z", 3).select("row", "col", "tpi"))


@query(f"""WITH {b.GR}, o AS (SELECT a.i - 2 AS dr, c.i - 2 AS dc FROM range(5) a(i), range(5) c(i) WHERE (a.i - 2) * (a.i - 2) + (c.i - 2) * (c.i - 2) <= 4) SELECT g.row, g.col, round(min(n.z), 6) AS low FROM gr g JOIN o ON true JOIN gr n ON n.row = g.row + dr AND n.col = g.col + dc GROUP BY 1, 2""")
def g04_focal_minimum(spark, d):
    return b.rounded(grid.focal(b.cells(spark, d), grid.disc(2), "z", "min").select("row", "col", F.col("z_focal").alias("low")))


@query(f"""WITH {b.GR}, x AS (SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, k % 4 AS k, count(*) AS n FROM gr GROUP BY 1, 2, 3) SELECT row, col, arg_min(k, (-n, k)) AS k FROM x GROUP BY 1, 2""")
def g13_mode_resample(spark, d):
    return grid.coarsened(b.cells(spark, d).withColumn("k", F.col("k") % 4), "k", 4, "mode")


@query(f"WITH {b.GR} SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(z), 6) AS z FROM gr GROUP BY 1, 2")
def g13_mean_resample(spark, d):
    return b.rounded(grid.coarsened(b.cells(spark, d), "z", 4))


@query(f"""WITH RECURSIVE {b.GR}, c AS (SELECT row, col, k % 3 AS k, row * 50 + col AS cell FROM gr), e AS (SELECT a.cell AS a, z.cell AS z FROM c a JOIN c z ON a.k = z.k AND abs(a.row - z.row) <= 1 AND abs(a.col - z.col) <= 1),
r AS (SELECT cell AS a, cell AS l FROM c UNION SELECT e.z, r.l FROM r JOIN e ON e.a = r.a WHERE r.l < e.z) SELECT row, col, k, CAST(min(l) AS BIGINT) AS patch FROM c JOIN r ON r.a = c.cell GROUP BY 1, 2, 3""")
def g07_patches(spark, d):
    shared_dir(spark)
    return grid.patches(b.cells(spark, d).withColumn("k", F.col("k") % 3), "k", 50)


@query(f"WITH {b.GR} SELECT CAST(row // 8 * 8 AS INT) AS r0, CAST(col // 8 * 8 AS INT) AS c0, count(*) AS n FROM gr GROUP BY 1, 2")
def g15_tiles(spark, d):
    return grid.tiles(b.cells(spark, d), 8).select(F.col("r0").cast("int").alias("r0"), F.col("c0").cast("int").alias("c0"), "n")


@query(f"""WITH {b.DD}, {b.ST}, {NB} SELECT dd.day, nb.src, nb.dst, round(km, 6) AS km FROM nb JOIN dd ON dd.fid = nb.src JOIN dd z ON z.fid = nb.dst AND z.day = dd.day WHERE rank <= 4 AND nb.src % 10 <> 0""", dates=("day",))
def j21_daily_edges(spark, d):
    s = b.stations(spark, d)
    e = spatial.neighbours(s, s, 4, 150.0).where(F.col("src") % 10 != 0).select("src", "dst", "km")
    day = b.daily_obs(spark, d).select("fid", "day")
    out = e.join(shuffled(day.withColumnRenamed("fid", "src")), "src").join(shuffled(day.withColumnRenamed("fid", "dst")), ["dst", "day"])
    return b.rounded(out.select("day", "src", "dst", "km"))


@query(f"""WITH {b.DD}, {b.ST}, {NB}, k AS (SELECT fid, avg(delta) AS v FROM dd WHERE fid % 10 <> 0 GROUP BY 1), e AS (SELECT src, km, v, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS r FROM nb JOIN k ON k.fid = nb.dst WHERE src % 10 = 0)
SELECT src AS fid, round(CASE WHEN count(*) >= 2 THEN sum(v / (km * km)) / sum(1 / (km * km)) END, 5) AS v, count(*) AS n FROM e WHERE r <= 6 GROUP BY 1""")
def g10_inverse_distance(spark, d):
    s = b.stations(spark, d)
    k = b.daily_obs(spark, d).where(F.col("fid") % 10 != 0).groupBy("fid").agg(F.avg("delta").alias("v")).join(shuffled(s), "fid")
    out = spatial.idw(k, s.where(F.col("fid") % 10 == 0), "v", 150.0, 6)
    return out.select("fid", F.round("v", 5).alias("v"), "n")


@query(f"""WITH {b.DD}, {b.ST} SELECT a.day, count(*) FILTER (fid % 10 = 0) AS held, count(*) FILTER (fid % 10 <> 0) AS open, count(*) AS n FROM dd a WHERE fid IN (SELECT fid FROM st) GROUP BY 1""", dates=("day",))
def a39_split_audit(spark, d):
    x = b.daily_obs(spark, d).join(shuffled(b.stations(spark, d).select("fid")), "fid", "left_semi")
    return x.groupBy("day").agg(F.count_if(F.col("fid") % 10 == 0).alias("held"), F.count_if(F.col("fid") % 10 != 0).alias("open"), F.count("*").alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def a41_largest_groups(spark, d):
    g = b.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))
    return g.orderBy(F.desc("n"), "segment").limit(3)


@query(f"""WITH {b.DD}, x AS (SELECT fid, day, list(round(obs, 6)) OVER (PARTITION BY fid ORDER BY day ROWS 2 PRECEDING) AS seq, min(day) OVER (PARTITION BY fid ORDER BY day ROWS 2 PRECEDING) AS a FROM dd)
SELECT fid, day AS "end", round(list_sum(seq), 5) AS total, seq[1] AS first FROM x WHERE len(seq) = 3 AND day - a = 2""", dates=('"end"',))
def w12_sequences(spark, d):
    s = series.sequences(b.daily_obs(spark, d).withColumn("obs", F.round("obs", 6)), "fid", "day", "obs", 3)
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)
    return s.select("fid", "end", F.round(total, 5).alias("total"), F.col("seq")[0].alias("first"))


