"""Functions, scans, quality control and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, met
from ..operators import qc, series, stats
from ..shared import shuffled
from . import bindings as b
from .registry import query

HAV = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({d}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({d}.lat)) * pow(sin(radians({d}.lon - {a}.lon) / 2), 2))))"


@query(f"""WITH {b.ST} SELECT fid, round(0.6108 * exp(17.27 * (elev / 100) / (elev / 100 + 237.3)), 6) AS es,
 round(0.61094 * exp(17.625 * (elev / 100) / (elev / 100 + 243.04)), 6) AS es_magnus,
 round(237.3 * ln((lat / 42) / 0.6108) / (17.27 - ln((lat / 42) / 0.6108)), 6) AS td,
 round(0.008 * 90 / nullif(0.622 + 0.378 * 0.008, 0) * lat / 42, 6) AS ea_q,
 round(0.622 * (lat / 42) / nullif(90 - 0.378 * (lat / 42), 0), 6) AS q,
 round(101.3 * pow((293.0 - 0.0065 * elev) / 293.0, 5.26), 6) AS pa,
 round(101.3 * pow((293.0 - 0.0065 * elev) / 293.0, 9.8 / (0.0065 * 286.9)), 6) AS pa_refet FROM st""")
def f01_humidity_pressure(spark, d):
    s = b.stations(spark, d)
    t, e = F.col("elev") / 100, F.col("lat") / 42
    q = F.lit(0.008)
    return b.rounded(s.select(
        "fid", met.vapour_pressure(t).alias("es"), met.vapour_pressure(t, met.MAGNUS).alias("es_magnus"), met.dew_point(e).alias("td"),
        (met.ea_from_q(q, F.lit(90.0)) * e).alias("ea_q"), met.q_from_ea(e, F.lit(90.0)).alias("q"),
        met.air_pressure(F.col("elev")).alias("pa"), met.air_pressure(F.col("elev"), "refet").alias("pa_refet"),
    ))


@query(f"""WITH {b.ST}, x AS (SELECT fid, CASE WHEN fid % 5 = 0 THEN lat / 42 END AS ea, CASE WHEN fid % 3 = 0 THEN elev / 200 END AS td,
 CASE WHEN fid % 2 = 0 THEN 80.0 END AS hi, CASE WHEN fid % 2 = 0 THEN 40.0 END AS lo, CASE WHEN fid % 7 = 0 THEN 60.0 END AS av,
 elev / 100 + 5 AS tx, elev / 100 - 5 AS tn FROM st)
SELECT fid, round(coalesce(ea, 0.6108 * exp(17.27 * td / (td + 237.3)),
 (0.6108 * exp(17.27 * tn / (tn + 237.3)) * hi / 100 + 0.6108 * exp(17.27 * tx / (tx + 237.3)) * lo / 100) / 2,
 0.6108 * exp(17.27 * ((tx + tn) / 2) / ((tx + tn) / 2 + 237.3)) * av / 100,
 0.6108 * exp(17.27 * (tn - 2) / (tn - 2 + 237.3))), 6) AS ea FROM x""")
def f04_compiled_ea(spark, d):
    on = lambda k, v: F.when(F.col("fid") % k == 0, v)
    tx, tn = F.col("elev") / 100 + 5, F.col("elev") / 100 - 5
    ea = met.compiled_ea(on(5, F.col("lat") / 42), on(3, F.col("elev") / 200), on(2, F.lit(80.0)), on(2, F.lit(40.0)), on(7, F.lit(60.0)), tx, tn, F.lit(2.0))
    return b.rounded(b.stations(spark, d).select("fid", ea.alias("ea")))


@query(f"""WITH {b.EV}, x AS (SELECT *, degrees(atan2(-u, -v)) AS a, 3.0 AS bu, 4.0 AS bv FROM ev)
SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS wdir,
 round(((u - bu) * bu + (v - bv) * bv) / 5, 6) AS par, round(((v - bv) * bu - (u - bu) * bv) / 5, 6) AS perp,
 round(ln(67.8 * 10 - 5.42) / ln(67.8 * (2 + event_id % 8) - 5.42), 6) AS neutral,
 round(value * 4.87 / ln(67.8 * (2 + event_id % 8) - 5.42), 6) AS u2 FROM x""")
def f06_wind(spark, d):
    u, v = F.col("u"), F.col("v")
    z = (2 + F.col("event_id") % 8).cast("double")
    par, perp = met.wind_residuals(u, v, F.lit(3.0), F.lit(4.0))
    return b.rounded(b.hourly(spark, d).select(
        "event_id", met.wind_speed(u, v).alias("speed"), met.wind_from(u, v).alias("wdir"), par.alias("par"), perp.alias("perp"),
        F.when(z == 10, 1.0).otherwise(met.neutral_factor(z)).alias("neutral"), met.to_two_metres(F.col("value"), z).alias("u2"),
    ))


@query(f"""WITH {b.EV}, x AS (SELECT event_id, 280 + event_id % 20 AS t2, 275 + event_id % 33 AS ts, 1.0 + event_id % 6 AS w, 0.02 + (event_id % 5) / 10.0 AS z0, 2.0 + event_id % 9 AS zw FROM ev),
y AS (SELECT *, 9.81 * 10 * (t2 - ts) / (0.5 * (t2 + ts) * w * w) AS ri FROM x),
l AS (SELECT *, 10 / CASE WHEN abs(least(ri, 0.19)) < 1e-6 THEN 1e-6 ELSE least(ri, 0.19) END AS len FROM y),
p AS (SELECT *, 10 / len AS zt, zw / len AS zb, pow(1 - 16 * least(10 / len, 0), 0.25) AS xt, pow(1 - 16 * least(zw / len, 0), 0.25) AS xb FROM l),
s AS (SELECT *, CASE WHEN zt > 0 THEN -5 * least(zt, 1) WHEN zt < 0 THEN 2 * ln((1 + xt) / 2) + ln((1 + xt * xt) / 2) - 2 * atan(xt) + pi() / 2 ELSE 0 END AS pt,
 CASE WHEN zb > 0 THEN -5 * least(zb, 1) WHEN zb < 0 THEN 2 * ln((1 + xb) / 2) + ln((1 + xb * xb) / 2) - 2 * atan(xb) + pi() / 2 ELSE 0 END AS pb FROM p),
f AS (SELECT *, ln(10 / z0) - pt AS top, CASE WHEN abs(ln(zw / z0) - pb) < 0.01 THEN 0.01 ELSE ln(zw / z0) - pb END AS bot FROM s)
SELECT event_id, round(ri, 6) AS ri, round(len, 5) AS len, round(CASE WHEN abs(zw - 10) < 0.1 THEN 1.0 ELSE greatest(0.5, least(3.0, top / bot)) END, 6) AS factor FROM f""")
def f09_stability(spark, d):
    e = F.col("event_id")
    t2, ts, w = (280 + e % 20).cast("double"), (275 + e % 33).cast("double"), 1.0 + e % 6
    z0, zw = 0.02 + (e % 5) / 10.0, 2.0 + e % 9
    ri = met.richardson(t2, ts, w)
    out = b.hourly(spark, d).select("event_id", ri.alias("ri"), met.obukhov(ri).alias("len"), met.stability_factor(t2, ts, w, z0, zw).alias("factor"))
    return out.select("event_id", F.round("ri", 6).alias("ri"), F.round("len", 5).alias("len"), F.round("factor", 6).alias("factor"))


@query(f"""WITH {b.EV}, x AS (SELECT event_id, day, 40 + event_id % 15 AS lat, event_id % 101 AS cloud, CAST(event_id % 2000 AS DOUBLE) AS elev, 20.0 + event_id % 12 AS tx, 5.0 + event_id % 9 AS tn FROM ev),
y AS (SELECT *, 2 * pi() / 365 * dayofyear(day) AS dy, radians(lat) AS phi FROM x), z AS (SELECT *, 0.409 * sin(dy - 1.39) AS tilt FROM y),
s AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi) * tan(tilt)))) AS ws FROM z),
r AS (SELECT *, greatest(0, 24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(dy)) * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws))) AS ra FROM s)
SELECT event_id, round(ra, 6) AS ra, round(0.75 * ra, 6) AS clear, round((0.25 + 0.5 * greatest(0, least(1, -0.0083 * cloud + 0.9659))) * ra / 0.0864, 6) AS rsds,
 round(ra * (1 - 0.9 * exp(-(0.031 + 0.201 * exp(-0.185 * 12)) * pow(tx - tn, 1.5))), 6) AS rs_tr FROM r""")
def f17_radiation(spark, d):
    e = F.col("event_id")
    lat, cloud, doy = (40 + e % 15).cast("double"), (e % 101).cast("double"), F.dayofyear("day")
    ra, gap = met.extraterrestrial(lat, doy), (20.0 + e % 12) - (5.0 + e % 9)
    return b.rounded(b.hourly(spark, d).select(
        "event_id", ra.alias("ra"), met.clear_sky(ra).alias("clear"), met.cloud_radiation(cloud, lat, doy).alias("rsds"),
        met.range_radiation(ra, gap, F.lit(12.0)).alias("rs_tr"),
    ))


@query(f"""WITH {b.ST}, x AS (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km,
 degrees(atan2(sin(radians(z.lon - a.lon)) * cos(radians(z.lat)), cos(radians(a.lat)) * sin(radians(z.lat)) - sin(radians(a.lat)) * cos(radians(z.lat)) * cos(radians(z.lon - a.lon)))) AS g,
 z.elev - a.elev AS dz FROM st a JOIN st z ON z.fid = a.fid + 1)
SELECT src, dst, round(km, 6) AS km, round(CASE WHEN g < 0 THEN g + 360 ELSE g END, 6) AS bearing, round(sin(radians(g)), 6) AS bsin, round(cos(radians(g)), 6) AS bcos, dz FROM x""")
def f12_edge_attributes(spark, d):
    s = b.stations(spark, d)
    side = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("fid", "lat", "lon", "elev")]
    e = s.select(*side(1)).withColumn("fid2", F.col("fid1") + 1).join(s.select(*side(2)), "fid2")
    p = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    g = geo.bearing(*p)
    return b.rounded(e.select(
        F.col("fid1").alias("src"), F.col("fid2").alias("dst"), geo.distance_km(*p).alias("km"), geo.bearing_degrees(*p).alias("bearing"),
        F.sin(g).alias("bsin"), F.cos(g).alias("bcos"), (F.col("elev2") - F.col("elev1")).alias("dz"),
    ))


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
y AS (SELECT *, month(day) * 100 + day(day) AS c, dayofyear(day) AS n FROM x)
SELECT o_orderkey, round(sin(2 * pi() * n / 365.25), 6) AS s, round(cos(2 * pi() * n / 365.25), 6) AS c, n - CASE WHEN day(last_day(make_date(year(day), 2, 1))) = 29 AND n > 60 THEN 1 ELSE 0 END AS doy,
 CASE WHEN y.c < 301 THEN 0 WHEN y.c < 501 THEN 1 WHEN y.c < 715 THEN 2 WHEN y.c < 930 THEN 3 ELSE 4 END AS p_calendar,
 CAST((n >= 60) AS INT) + CAST((n >= 121) AS INT) + CAST((n >= 196) AS INT) + CAST((n >= 273) AS INT) AS p_doy FROM y""")
def f14_seasons(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    s, c = geo.season(F.col("day"))
    return b.rounded(o.select("o_orderkey", s.alias("s"), c.alias("c"), geo.doy365(F.col("day")).alias("doy"),
                              geo.period(F.col("day")).alias("p_calendar"), geo.period(F.col("day"), "doy").alias("p_doy")))


@query(f"""WITH {b.ST}, x AS (SELECT fid, CAST(fid % 361 - 1 AS DOUBLE) AS a, elev FROM st), y AS (SELECT *, CASE WHEN a < 0 THEN 0 ELSE CAST(floor(fmod(a + 22.5, 360) / 45) AS INT) + 1 END AS k FROM x)
SELECT fid, k, round(CASE WHEN k = 0 THEN 0 ELSE sin(radians((k - 1) * 45.0)) END, 6) AS s, round(CASE WHEN k = 0 THEN 0 ELSE cos(radians((k - 1) * 45.0)) END, 6) AS c,
 round(greatest(0, least(1, (elev - 75) / 175)), 6) AS ramp, CAST(trunc((elev - 10) / 7) AS INT) AS cell_t, CAST(round_even((elev - 10) / 7, 0) AS INT) AS cell_c, round(elev * 0.3048, 6) AS metres,
 round(elev * 5.0 / 9.0 - 160.0 / 9.0, 6) AS celsius, round(CASE WHEN elev <> 0 THEN greatest(0, (elev - 500) * 1e-4) END, 6) AS band FROM y""")
def f25_terrain_units(spark, d):
    s = b.stations(spark, d).withColumn("a", (F.col("fid") % 361 - 1).cast("double"))
    k = geo.aspect_class(F.col("a"))
    sn, cs = geo.class_vector(k)
    e = F.col("elev")
    return b.rounded(s.select(
        "fid", k.alias("k"), sn.alias("s"), cs.alias("c"), geo.ramp(e).alias("ramp"), geo.cell(e, 10.0, 7.0).alias("cell_t"), geo.cell(e, 10.0, 7.0, "centre").alias("cell_c"),
        geo.convert(e, "ft_to_m").alias("metres"), geo.convert(e, "f_to_c").alias("celsius"), F.when(e != 0, F.greatest(F.lit(0.0), (e - 500) * 1e-4)).alias("band"),
    ))


@query("""SELECT c_custkey AS fid, upper(substr(regexp_replace(trim(c_name), '\\W+', '_', 'g'), 1, 10)) AS sid, split_part(c_name, '#', 2) AS tail, substr(c_mktsegment, 1, 8) AS provider,
 round(-(c_custkey % 90 + (c_custkey % 60) / 60.0 + 30 / 3600.0), 6) AS dms FROM customer""")
def f28_text(spark, d):
    k = F.col("c_custkey")
    text = F.format_string("%d°%d'30\"W", k % 90, k % 60)
    return b.rounded(b.table(spark, d, "customer").select(
        k.alias("fid"), geo.station_id(F.col("c_name")).alias("sid"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"),
        F.substring("c_mktsegment", 1, 8).alias("provider"), geo.dms(text).alias("dms"),
    ))


@query("""SELECT vec_id AS fid, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 5) AS gap2,
 round(CAST(embedding[1] AS DOUBLE) - CAST(embedding[64] AS DOUBLE), 6) AS first FROM embeddings""")
def f32_arrays(spark, d):
    v = b.vectors(spark, d)
    gap = geo.array_gap(F.col("vec"), F.reverse("vec"))
    dist = geo.array_distance(F.col("vec"), F.reverse("vec"))
    return v.select("fid", F.round(dist * dist, 5).alias("gap2"), F.round(gap[0], 6).alias("first"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1]) AS xs, quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS ys FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber, l_quantity - 1 AS x, xs, ys, len(list_filter(xs, lambda v: v <= l_quantity - 1)) AS k FROM lineitem JOIN q USING (l_returnflag))
SELECT l_orderkey, l_linenumber, round(CASE WHEN k = 0 THEN ys[1] WHEN k >= 5 THEN ys[5] ELSE ys[k] + (ys[k + 1] - ys[k]) * (x - xs[k]) / nullif(xs[k + 1] - xs[k], 0) END, 4) AS y FROM x""")
def f22_quantile_map(spark, d):
    l = b.table(spark, d, "lineitem")
    q = stats.breakpoints(l, ["l_returnflag"], "l_quantity", "l_extendedprice", 5)
    y = geo.quantile_map(F.col("l_quantity") - 1, F.col("xs"), F.col("ys"))
    return l.join(F.broadcast(q), "l_returnflag").select("l_orderkey", "l_linenumber", F.round(y, 4).alias("y"))  # one row a flag


@query(f"WITH {b.EV} SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM ev")
def f33_json(spark, d):
    return b.hourly(spark, d).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("""SELECT o_custkey AS fid, CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(max(o_totalprice), 6) AS top FROM orders
 WHERE o_orderstatus IN ('F', 'O') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1, 2""", dates=("day",))
def src01_daily_scan(spark, d):
    o = b.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    o = o.where(F.col("o_orderstatus").isin("F", "O") & F.col("day").between("1995-01-01", "1996-12-31"))
    return b.rounded(o.groupBy(F.col("o_custkey").alias("fid"), "day").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def src02_manifest_gate(spark, d):
    done = b.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    l = b.table(spark, d, "lineitem").join(done, "l_orderkey", "left_semi")
    return b.rounded(l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")))


@query(f"WITH {b.EV} SELECT event_id, CAST(ts + INTERVAL 5 HOUR AS DATE) AS utc_start, CAST(CAST(day AS TIMESTAMP) + INTERVAL 17 HOUR AS DATE) AS utc_midpoint FROM ev", dates=("utc_start", "utc_midpoint",))
def src04_day_modes(spark, d):
    e = b.hourly(spark, d)
    noon = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS"), "-05:00")
    return e.select("event_id", F.to_date(F.to_utc_timestamp("ts", "-05:00")).alias("utc_start"), F.to_date(noon).alias("utc_midpoint"))


@query("""SELECT user_id AS fid, CAST(ts AS DATE) AS day, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view,
 round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1, 2""", dates=("day",))
def src08_long_to_wide(spark, d):
    e = b.hourly(spark, d).groupBy("fid", "day").pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("value"))
    return b.rounded(e)


@query("""SELECT * FROM (SELECT l_orderkey AS slot, l_linenumber AS line, l_returnflag AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'A') = (CAST(l_shipdate AS DATE) <= DATE '1996-06-30') DESC, l_returnflag, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def src17_source_preference(spark, d):
    l = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("source"), F.to_date("l_shipdate").alias("day"))
    first = (F.col("source") == "A") == (F.col("day") <= "1996-06-30")
    return series.one_of_each(l, ["slot"], [first.desc(), F.col("source"), F.col("line")]).select("slot", "line", "source", F.lit(1).alias("r"))


@query(f"WITH {b.ST} SELECT fid, lat, lon FROM st WHERE lat >= 43 AND lat < 47 AND lon >= -120 AND lon < -110")
def p01_box(spark, d):
    return qc.inside(b.stations(spark, d), -120, 43, -110, 47).select("fid", "lat", "lon")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'N') AND (coalesce(l_linenumber, 0) & 5) = 0 AND l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS q,
 CASE WHEN l_linestatus IN ('O') AND (coalesce(l_linenumber, 0) & 5) = 0 AND l_discount BETWEEN 0.02 AND 0.08 THEN l_discount END AS s FROM lineitem)
SELECT *, q IS NOT NULL OR s IS NOT NULL AS qc_passed FROM x""")
def p02_three_layers(spark, d):
    l, bits = b.table(spark, d, "lineitem"), F.col("l_linenumber")
    q = qc.checked(F.col("l_quantity"), F.col("l_returnflag"), bits, 5, 45, ("A", "N"), 5)
    s = qc.checked(F.col("l_discount"), F.col("l_linestatus"), bits, 0.02, 0.08, ("O",), 5)
    out = l.select("l_orderkey", "l_linenumber", q.alias("q"), s.alias("s"))
    return out.withColumn("qc_passed", F.col("q").isNotNull() | F.col("s").isNotNull())


@query(f"WITH {b.DD} SELECT fid, day, round(CASE WHEN abs(delta) <= 40 THEN delta END, 6) AS delta, round(CASE WHEN obs BETWEEN 20 AND 80 THEN obs END, 6) AS obs, CASE WHEN obs BETWEEN 20 AND 80 THEN 0 ELSE 1 END AS obs_miss FROM dd", dates=("day",))
def p07_limits_and_flags(spark, d):
    x = qc.limited(b.daily_obs(spark, d), {"delta": (-40, 40), "obs": (20, 80), "base": None})
    return b.rounded(qc.flagged(x, ["obs"]).select("fid", "day", "delta", "obs", "obs_miss"))


@query(f"WITH {b.ST} SELECT segment, count(*) AS n FROM st WHERE fid NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def p10_reject_list(spark, d):
    rej = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("fid"))
    return qc.rejected(b.stations(spark, d), rej).groupBy("segment").agg(F.count("*").alias("n"))


@query(f"""WITH {b.ST} SELECT path, provider8, count(*) AS n FROM (SELECT CASE WHEN substr(coalesce(segment, 'UNKNOWN'), 1, 8) IN ('BUILDING', 'MACHINER') THEN 'provider' WHEN fid % 7 = 0 THEN 'station' WHEN fid % 11 = 0 THEN 'bin' END AS path,
 substr(coalesce(segment, 'UNKNOWN'), 1, 8) AS provider8 FROM st WHERE fid % 13 <> 0) WHERE path IS NOT NULL GROUP BY 1, 2""")
def p11_accept_rule(spark, d):
    s = b.stations(spark, d).withColumnRenamed("segment", "provider")
    part = lambda k: s.where(F.col("fid") % k == 0)
    out = qc.accepted(s, ["BUILDING", "MACHINER"], part(7), part(11), part(13))
    return out.groupBy("path", F.substring(F.coalesce("provider", F.lit("UNKNOWN")), 1, 8).alias("provider8")).agg(F.count("*").alias("n"))


@query(f"""WITH {b.EV}, q AS (SELECT fid, quantile_cont(value, 0.5) AS med, max(value) AS top, quantile_cont(value, 0.99) AS p99 FROM ev GROUP BY 1)
SELECT fid, round(med, 6) AS med, round(top, 6) AS top, round(p99, 6) AS p99, CASE WHEN med > 200 THEN 'k_to_c' END AS temperature, CASE WHEN p99 > 500 THEN 'hundredths' END AS rain FROM q""")
def p16_units(spark, d):
    f = qc.unit_facts(b.hourly(spark, d), "fid", "value")
    return b.rounded(f.withColumns({"temperature": qc.guessed_unit("temperature"), "rain": qc.guessed_unit("rain")}))


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a), b), 4) AS x FROM lineitem, q")
def p18_winsorise(spark, d):
    out = qc.winsorised(b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x")), ["x"])
    return out.withColumn("x", F.round("x", 4))


@query(f"WITH {b.DD}, m AS (SELECT quantile_cont(delta, 0.5) FILTER (fid % 10 <> 0 AND n > 1) AS m FROM dd) SELECT fid, day, round(coalesce(CASE WHEN n > 1 THEN delta END, m, 0), 6) AS delta FROM dd, m", dates=("day",))
def p19_train_median(spark, d):
    x = b.daily_obs(spark, d).withColumn("delta", F.when(F.col("n") > 1, F.col("delta"))).select("fid", "day", "delta")
    return b.rounded(qc.filled_by_train_median(x, ["delta"], F.col("fid") % 10 != 0))


@query(f"""WITH {b.DD}, m AS (SELECT fid, quantile_cont(obs, 0.5) AS m FROM dd GROUP BY 1), k AS (SELECT dd.fid, quantile_cont(abs(obs - m), 0.5) AS k FROM dd JOIN m ON dd.fid = m.fid GROUP BY 1)
SELECT dd.fid, day, round(0.6745 * (obs - m) / nullif(k, 0), 6) AS z FROM dd JOIN m ON dd.fid = m.fid JOIN k ON dd.fid = k.fid""", dates=("day",))
def q01_modified_z(spark, d):
    return b.rounded(qc.modified_z(b.daily_obs(spark, d).select("fid", "day", "obs"), ["fid"], "obs").select("fid", "day", "z"))


@query(f"WITH {b.DD} SELECT fid, day, round(CASE WHEN count(obs) OVER (PARTITION BY fid ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY FOLLOWING) > 1 THEN obs END, 6) AS obs FROM dd", dates=("day",))
def q04_isolated(spark, d):
    return b.rounded(qc.isolated(b.daily_obs(spark, d).select("fid", "day", "obs"), "fid", F.unix_date("day"), "obs", 2))


@query(f"""WITH {b.DD}, x AS (SELECT fid, day, n, CASE WHEN delta < 0 THEN n ELSE 0 END AS bad FROM dd),
y AS (SELECT *, sum(bad) OVER w / nullif(sum(n) OVER w, 0) AS rate FROM x WINDOW w AS (PARTITION BY fid ORDER BY day RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW)) SELECT fid, day, n, bad, round(rate, 6) AS rate, rate > 0.5 AS listed FROM y""", dates=("day",))
def st06_rejection_monitor(spark, d):
    x = b.daily_obs(spark, d).select("fid", "day", "n", F.when(F.col("delta") < 0, F.col("n")).otherwise(0).alias("bad"))
    return b.rounded(qc.rejection_monitor(x, 10))


@query(f"""WITH {b.DD}, c AS (SELECT fid, day, avg(value) AS clim FROM ev WHERE event_type = 'view' GROUP BY 1, 2) SELECT dd.fid, dd.day, round(obs, 6) AS obs, round(clim, 6) AS clim, round(dd.delta, 6) AS delta, elev
 FROM dd LEFT JOIN c ON dd.fid = c.fid AND dd.day = c.day JOIN (WITH {b.ST} SELECT * FROM st) s ON s.fid = dd.fid""", dates=("day",))
def j02_station_day(spark, d):
    c = b.hourly(spark, d).where("event_type = 'view'").groupBy("fid", "day").agg(F.avg("value").alias("clim"))
    out = b.daily_obs(spark, d).join(shuffled(c), ["fid", "day"], "left").join(shuffled(b.stations(spark, d).select("fid", "elev")), "fid")
    return b.rounded(out.select("fid", "day", "obs", "clim", "delta", "elev"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), z AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1)
SELECT day, round(x, 2) AS x, round(y, 2) AS y FROM a FULL JOIN z USING (day)""", dates=("day",))
def j05_full_outer(spark, d):
    a = b.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    z = b.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("y"))
    return b.rounded(a.join(z, "day", "full_outer"), 2)


@query("""WITH r AS (SELECT l_orderkey, epoch(l_shipdate) AS t FROM lineitem), x AS (SELECT o_orderkey, epoch(o_orderdate) AS t FROM orders),
y AS (SELECT x.o_orderkey, abs(r.t - x.t) AS gap, r.t AS rt FROM x JOIN r ON r.l_orderkey = x.o_orderkey AND abs(r.t - x.t) <= 2592000)
SELECT o_orderkey AS k, CAST(min(gap) AS BIGINT) AS gap FROM y GROUP BY 1""")
def j27_nearest_in_time(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"))
    l = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("s"))
    return series.nearest_in_time(o, l, "k", "t", "s", 2592000).select("k", "gap")


@query("SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def j33_missing_set(spark, d):
    c = b.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"))
    return b.table(spark, d, "supplier").join(c, "s_suppkey", "left_anti").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("s"))


@query("SELECT user_id AS fid, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1")
def j34_first_seen(spark, d):
    return b.hourly(spark, d).groupBy("fid").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query(f"""WITH {b.EV}, a AS (SELECT fid, day, avg(value) AS x FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2), c AS (SELECT fid, day, avg(value) AS x FROM ev WHERE event_type = 'view' GROUP BY 1, 2)
SELECT fid, day, round(coalesce(a.x, c.x), 6) AS x FROM a FULL JOIN c USING (fid, day)""", dates=("day",))
def j36_priority_fill(spark, d):
    part = lambda t: b.hourly(spark, d).where(F.col("event_type") == t).groupBy("fid", "day").agg(F.avg("value").alias("x"))
    return b.rounded(series.coalesced(part("purchase"), [part("view")], ["fid", "day"], "x"))


@query("""SELECT id, min(src) AS src, count(*) AS n FROM (SELECT upper(substr(regexp_replace(trim(c_name), '\\W+', '_', 'g'), 1, 14)) AS id, 'a' AS src FROM customer
 UNION ALL SELECT upper(substr(regexp_replace(trim(s_name), '\\W+', '_', 'g'), 1, 14)), 'b' FROM supplier) GROUP BY 1""")
def u05_inventory_merge(spark, d):
    a = b.table(spark, d, "customer").select(geo.station_id(F.col("c_name"), 14).alias("id"), F.lit("a").alias("src"))
    z = b.table(spark, d, "supplier").select(geo.station_id(F.col("s_name"), 14).alias("id"), F.lit("b").alias("src"))
    return a.unionByName(z).groupBy("id").agg(F.min("src").alias("src"), F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03_intersection(spark, d):
    return b.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(b.table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u04_difference(spark, d):
    a = b.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.subtract(b.table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
