"""Sinks, gates, text rules, climatology and streams over the tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..operators import climatology, grid, halo, qc, series, spatial, stats
from ..shared import shared_dir, shuffled
from ..sources import sinks, text
from ..streaming import streams, upserts
from . import bindings as b
from .queries_rows import HAV
from .registry import SQL as REGISTRY
from .registry import query


@query("""SELECT o_custkey AS fid, CAST(o_orderdate AS DATE) AS day, round(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(max(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END), 2) AS other,
 round(coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), max(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END)), 2) AS x FROM orders GROUP BY 1, 2""", dates=("day",))
def snk03_keep_last(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("fid"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_totalprice")
    side = lambda cond: o.where(cond).groupBy("fid", "day").agg(F.max("o_totalprice").alias("x"))
    new, old = side("o_orderstatus = 'F'"), side("o_orderstatus <> 'F'")
    out = sinks.keep_last(old, new, ["fid", "day"])
    out = out.join(new.withColumnRenamed("x", "f"), ["fid", "day"], "left").join(old.withColumnRenamed("x", "other"), ["fid", "day"], "left")
    return b.rounded(out, 2)


@query(f"WITH {b.DD}, w AS (SELECT DISTINCT day FROM dd) SELECT day FROM w WHERE day NOT IN (SELECT day FROM dd WHERE n >= 1 GROUP BY day HAVING count(DISTINCT fid) >= 135)", dates=("day",))
def snk04_resume(spark, d):
    x = b.daily_obs(spark, d).select("fid", "day")
    return sinks.days_to_do(x.select("day").distinct(), x, 135)


@query(f"""WITH {b.ST} SELECT dataset, count(*) AS n FROM (SELECT fid, 'events' AS dataset FROM st WHERE fid NOT IN (SELECT user_id FROM events) UNION ALL SELECT fid, 'orders' FROM st WHERE fid NOT IN (SELECT o_custkey FROM orders)) GROUP BY 1""")
def snk05_missing_inputs(spark, d):
    s = b.stations(spark, d)
    parts = {"events": b.hourly(spark, d), "orders": b.table(spark, d, "orders").select(F.col("o_custkey").alias("fid"))}
    return sinks.missing_inputs(s, parts).groupBy("dataset").agg(F.count("*").alias("n"))


@query(f"""WITH {b.DD}, r AS (SELECT date_diff('day', min(day), max(day)) + 1 AS days FROM dd) SELECT fid, CAST(days AS INT) AS days, count(*) AS known, round(sum(obs), 4) AS total FROM dd, r GROUP BY fid, days""")
def snk06_dense_matrix(spark, d):
    """A value for every station and day from the first day of the table to its last."""
    x = b.daily_obs(spark, d).select("fid", "day", "obs")
    ends = x.agg(F.min("day").cast("string").alias("a"), F.max("day").cast("string").alias("z")).first()
    m = sinks.dense_matrix(x, "obs", ends.a, ends.z)
    known = F.filter("series", lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return m.select("fid", F.size("series").alias("days"), F.size(known).cast("long").alias("known"), F.round(total, 4).alias("total"))


@query(f"""WITH {b.EV}, o AS (SELECT fid, day, avg(value) AS x FROM ev GROUP BY 1, 2), n AS (SELECT fid, day, avg(value) AS x FROM ev WHERE event_type = 'click' GROUP BY 1, 2)
SELECT o.fid, o.day, round(coalesce(n.x, o.x), 6) AS x, CASE WHEN n.fid IS NULL THEN 1 ELSE 0 END AS repeated FROM o LEFT JOIN n ON n.fid = o.fid AND n.day = o.day""", dates=("day",))
def snk09_overlay(spark, d):
    e = b.hourly(spark, d)
    old = e.groupBy("fid", "day").agg(F.avg("value").alias("x")).withColumn("repeated", F.lit(1))
    new = e.where("event_type = 'click'").groupBy("fid", "day").agg(F.avg("value").alias("x"))
    return b.rounded(sinks.overlay(old, new, ["fid", "day"], ["x"]).select("fid", "day", "x", "repeated"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS fid, round(c_acctbal / 200, 6) AS lat, CAST(c_nationkey AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS elev FROM customer")
def src05_inventory(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("Station_ID"), (F.col("c_acctbal") / 200).alias("Latitude"), F.col("c_nationkey").alias("LON"))
    return b.rounded(text.inventory(c))


@query("""SELECT p_partkey AS fid, make_date(2000 + p_partkey % 20, CASE i WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END, 1) AS day, band, round(value, 4) AS value FROM (
 SELECT p_partkey, 0 AS i, 'B2' AS band, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 1, 'B2', p_retailprice * 2 FROM part UNION ALL SELECT p_partkey, 2, 'B10', CAST(p_size AS DOUBLE) FROM part)""", dates=("day",))
def src10_wide_bands(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("fid"), (2000 + F.col("p_partkey") % 20).alias("y"), F.col("p_retailprice").alias("B2_0"), (F.col("p_retailprice") * 2).alias("B2_1"), F.col("p_size").alias("B10_2"))
    return b.rounded(text.wide_bands(p, "fid", "y", {0: "01-01", 1: "03-01", 2: "05-01"}), 4)


@query("""WITH f AS (SELECT o_custkey AS fid, count(DISTINCT date_trunc('month', o_orderdate)) AS m FROM orders GROUP BY 1) SELECT o_custkey AS fid, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders WHERE o_custkey IN (SELECT fid FROM f WHERE m >= 8) GROUP BY 1""")
def src12_month_gate(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("fid"), F.to_date("o_orderdate").alias("day"))
    return text.complete_months(o, "fid", "day", 8, 1_000_000, "INTERVAL 1 DAY").groupBy("fid").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS fid, c_acctbal AS bal FROM customer WHERE c_acctbal / 50 BETWEEN -90 AND 90 AND c_nationkey IS NOT NULL")
def p21_entry_validation(spark, d):
    c = b.table(spark, d, "customer")
    return c.where((F.col("c_acctbal") / 50).between(-90, 90) & F.col("c_nationkey").isNotNull()).select(F.col("c_custkey").alias("fid"), F.col("c_acctbal").alias("bal"))


@query(f"WITH {b.DD} SELECT fid, day, round(delta, 6) AS delta FROM dd WHERE delta IS NOT NULL", dates=("day",))
def p06_baseline_guard(spark, d):
    x = b.daily_obs(spark, d).withColumn("source", F.lit("urma")).select("fid", "day", "delta", "source", F.col("obs").alias("dew_obs"))
    kept = qc.without_leaks(qc.assert_baseline(x, "delta", "source", ["urma", "rtma"]))
    return b.rounded(qc.with_targets(kept, ["delta"]).select("fid", "day", "delta"))


@query(f"""WITH {b.SE}, x AS (SELECT channel, day, max(a) AS a FROM se GROUP BY 1, 2), y AS (SELECT min(year(day)) AS y FROM x)
SELECT x.channel, year(x.day) AS year, count(*) AS days, count(*) FILTER (abs(x.a - z.a) <= 1e-9) AS repeated FROM x CROSS JOIN y LEFT JOIN x z ON z.channel = x.channel AND year(z.day) = y.y AND dayofyear(z.day) = dayofyear(x.day) GROUP BY 1, 2""")
def w11_repeated_years(spark, d):
    """Days of each channel and year whose highest value is that of the first year's day."""
    x = b.sensors(spark, d).groupBy("channel", "day").agg(F.max("a").alias("a"))
    first = x.agg(F.min(F.year("day"))).first()[0]
    return series.repeated_years(x, "channel", "day", ["a"], first).select("channel", "year", "days", "repeated")


@query(f"""WITH {b.ST}, v AS (SELECT vec_id AS fid, embedding FROM embeddings), e AS (SELECT src, dst, km, list_sum(list_transform(list_zip(a.embedding, z.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS g2 FROM (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON a.fid <> z.fid) JOIN v a ON a.fid = src JOIN v z ON z.fid = dst WHERE km <= 120),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY g2, dst) AS near, row_number() OVER (PARTITION BY src ORDER BY g2 DESC, dst DESC) AS far, count(*) OVER (PARTITION BY src) AS n FROM e)
SELECT src, dst, round(km, 5) AS km FROM r WHERE n <= 10 OR near <= 7 OR far <= 3""")
def j14_similar_neighbours(spark, d):
    s, v = b.stations(spark, d), b.vectors(spark, d)
    points = s.select("fid", "lat", "lon").join(shuffled(v.select("fid", "vec")), "fid")  # others have no candidates and are none
    return spatial.similar_neighbours(points, 120.0, 10).select("src", "dst", F.round("km", 5).alias("km"))


@query(f"""WITH {b.ST}, c AS (SELECT src, dst, km FROM (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON a.fid <> z.fid) WHERE km <= 150),
l AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY km, src) AS r FROM c WHERE km <= 40), n AS (SELECT src, dst, km FROM l WHERE r <= 3), h AS (SELECT dst, count(*) AS n FROM n GROUP BY 1),
f AS (SELECT c.src, c.dst, c.km, row_number() OVER (PARTITION BY c.dst ORDER BY km, src) AS r, 8 - coalesce(h.n, 0) AS room FROM c LEFT JOIN h ON h.dst = c.dst WHERE km > 40)
SELECT src, dst, round(km, 6) AS km FROM n UNION ALL SELECT src, dst, round(km, 6) FROM f WHERE r <= room""")
def j23_mixed_local(spark, d):
    s = b.stations(spark, d)
    return b.rounded(spatial.pruned_mixed(s, 40.0, 150.0, 3, 8))


@query(f"""WITH {b.GR}, o AS (SELECT * FROM (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) t(ray, dr, dc)), s AS (SELECT CAST(i AS INT) AS s FROM range(1, 5) t(i)),
p AS (SELECT row * 50 + col AS fid, row, col, z FROM gr) SELECT fid, ray, round(greatest(0, coalesce(max((gr.z - p.z) / (s * 10.0 * sqrt(abs(dr) + abs(dc)))), 0)), 5) AS sx
FROM p, o, s LEFT JOIN gr ON gr.row = p.row + s * dr AND gr.col = p.col + s * dc GROUP BY 1, 2""")
def g14_shelter_all(spark, d):
    """Shelter of every cell."""
    out = halo.rays(b.cells(spark, d), "z", 10.0, 4)
    return out.select((F.col("row") * 50 + F.col("col")).alias("fid"), "ray", F.round("sx", 5).alias("sx"))


@query(f"WITH {b.GR}, a AS (SELECT count(*) AS n, count(z) AS v, min(z) AS lo, max(z) AS hi FROM gr) SELECT 'not_empty' AS \"check\", n > 0 AS ok, CAST(n AS DOUBLE) AS detail FROM a UNION ALL SELECT 'has_values', v > 0, v FROM a UNION ALL SELECT 'low', lo >= 0, lo FROM a UNION ALL SELECT 'high', hi <= 1000, hi FROM a")
def g18_layer_checks(spark, d):
    return grid.layer_checks(b.cells(spark, d), "z", 0, 1000)


@query(f"WITH {b.GR}, x AS (SELECT row, col, CASE WHEN k % 5 = 0 THEN NULL ELSE z END AS z, k % 4 AS p FROM gr) SELECT row, col, round(coalesce(z, avg(z) OVER (PARTITION BY p)), 6) AS z FROM x")
def a15_climatology_fill(spark, d):
    g = b.cells(spark, d).select("row", "col", F.when(F.col("k") % 5 != 0, F.col("z")).alias("z"), (F.col("k") % 4).alias("p"))
    return b.rounded(grid.climatology_fill(g, ["p"], "z").select("row", "col", "z"))


@query(f"""WITH {b.GR}, p AS (SELECT row * 50 + col AS id, row + 0.25 AS y, col + 0.5 AS x FROM gr), c AS (SELECT id, CAST(floor(y) AS INT) + a.i AS r, CAST(floor(x) AS INT) + z.i AS c, (1 - abs(y - (floor(y) + a.i))) * (1 - abs(x - (floor(x) + z.i))) AS w FROM p, range(2) a(i), range(2) z(i))
SELECT id, round(sum(w * gr.z) / nullif(sum(w), 0), 6) AS z FROM c JOIN gr ON gr.row = r AND gr.col = c GROUP BY 1""")
def g13_bilinear(spark, d):
    g = b.cells(spark, d)
    p = g.select((F.col("row") * 50 + F.col("col")).alias("id"), (F.col("row") + 0.25).alias("y"), (F.col("col") + 0.5).alias("x"))
    return b.rounded(grid.bilinear(g, p, "z"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem")
def a35_linear_fit(spark, d):
    w = climatology.line(b.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return w.select(F.round("intercept", 3).alias("intercept"), F.round("slope", 4).alias("slope"), "n")


@query()
def a34_harmonics(spark, d):
    """Two cycles fitted to each nation's daily order values."""
    o = b.table(spark, d, "orders").join(b.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_nationkey").cast("long").alias("fid"), F.dayofyear("o_orderdate").alias("doy"), F.col("o_totalprice").alias("v"))
    h = climatology.harmonics(o, "fid", "doy", "v")
    return h.select("fid", F.round(F.col("coef")[0], 3).alias("mean"), F.round("r2", 6).alias("r2"), "n")


@query(
    f"""WITH {b.EV}, x AS (SELECT fid, day, avg(value) AS mean, max(value) AS top, min(value) AS low, count(value) AS n FROM ev GROUP BY 1, 2)
SELECT fid, day, round(mean, 6) AS mean, round(top, 6) AS top, round(low, 6) AS low, n FROM x WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 6 HOUR FROM ev)""",
    dates=("day",),
)
def st01_daily_stream(spark, d):
    """The daily aggregate as a stream over the whole table; days that the watermark has closed."""
    path = f"{shared_dir(spark)}/daily-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = streams.daily_stream(events.select(F.col("user_id").alias("fid"), F.col("ts").cast("timestamp").alias("ts"), "value"))
    run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
    run.trigger(availableNow=True).start().awaitTermination()
    return b.rounded(spark.read.schema(out.schema).parquet(path))


def _events(spark, d):
    """The whole table of events as a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return events.select(F.col("user_id").alias("fid"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def _run(stream, path):
    """Runs a stream into Parquet until its input is read."""
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
    run.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query(f"""WITH {b.EV}, r AS (SELECT *, row_number() OVER (PARTITION BY fid, day ORDER BY event_id DESC) AS r FROM ev)
SELECT fid, day, event_id, round(value, 6) AS value FROM r WHERE r = 1""", dates=("day",))
def st02_upsert(spark, d):
    """Late rows merged by station and day, batch by batch; the row of the greatest id stays."""
    path = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    rows = _events(spark, d).select("fid", F.to_date("ts").alias("day"), "event_id", "value")
    kept = upserts.UpsertTable(spark, path, ["fid", "day"], ["event_id"], "day")
    run = rows.writeStream.foreachBatch(kept.merge)
    run.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return b.rounded(kept.read())


@query(REGISTRY["st06_rejection_monitor"])
def st06_rejection_stream(spark, d):
    """The monitor of st06 as a stream: days come in five batches, out of order, and each goes out when it closes.

    A row of a later day, of a station of its own, lets the watermark pass all others.
    """
    path = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    bad = F.when(F.col("delta") < 0, F.col("n")).otherwise(0)
    x = b.daily_obs(spark, d).select("fid", "day", "n", bad.alias("bad")).withColumn("place", F.unix_date("day") + F.col("fid") % 5)
    ends = x.agg(F.min("place").alias("a"), F.max("place").alias("z"), F.max("day").alias("last")).first()
    for i in range(5):
        cut = [ends.a + (ends.z + 1 - ends.a) * k // 5 for k in (i, i + 1)]
        x.where((F.col("place") >= cut[0]) & (F.col("place") < cut[1])).drop("place").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1, ends.last + datetime.timedelta(days=100), 0, 0)], x.drop("place").schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(x.drop("place").schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _run(streams.rejection_stream(stream, 10), f"{path}-out")
    return b.rounded(out.withColumn("day", F.col("day").cast("string")))


@query(f"WITH {b.EV} SELECT day, count(*) AS n, round(sum(value), 3) AS total FROM ev GROUP BY 1", dates=("day",))
def st03_resume(spark, d):
    """Two runs over one checkpoint: the second one finds everything done and adds nothing."""
    path = f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    rows = _events(spark, d).select("fid", F.to_date("ts").alias("day"), "value")
    _run(rows, path)
    days = _run(rows, path).groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return b.rounded(days, 3)


@query(f"""WITH {b.EV}, g AS (SELECT fid, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY fid ORDER BY ts) <= INTERVAL 86401 SECOND THEN 0 ELSE 1 END AS fresh FROM ev),
s AS (SELECT fid, ts, sum(fresh) OVER (PARTITION BY fid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT fid, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 86401 AS stop, count(*) AS n FROM s GROUP BY fid, run
HAVING max(ts) + INTERVAL 86401 SECOND <= (SELECT max(ts) - INTERVAL 1 DAY FROM ev)""")
def st04_runs(spark, d):
    """Runs of consecutive days that the watermark has closed."""
    runs = _run(streams.run_stream(_events(spark, d)), f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}")
    return runs.select("fid", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("stop"), "n")


@query(f"""WITH {b.EV}, w AS (SELECT fid, unnest(generate_series(CAST(floor(epoch(ts) / 86400) AS BIGINT) - 6, CAST(floor(epoch(ts) / 86400) AS BIGINT))) AS s FROM ev)
SELECT fid, s AS start_day, count(*) AS n FROM w WHERE s % 2 = 0 AND s + 7 <= (SELECT (epoch(max(ts)) - 86400) / 86400 FROM ev) GROUP BY 1, 2 HAVING count(*) >= 3""")
def st05_windows(spark, d):
    """Windows of seven days, every second day, with three rows or more, that the watermark has closed."""
    slides = _run(streams.sliding_stream(_events(spark, d), 7, 2, 3), f"{shared_dir(spark)}/slides-{uuid.uuid4().hex}")
    return slides.select("fid", F.floor(F.unix_timestamp("start") / 86400).alias("start_day"), "n")


@query(f"""WITH {b.SE}, x AS (SELECT 'a' AS col, CAST(a AS DOUBLE) AS x FROM se UNION ALL SELECT 'b', b FROM se), m AS (SELECT col, min(x) AS lo, max(x) - min(x) AS span FROM x GROUP BY 1),
z AS (SELECT x.col, x, (x - lo) / span + 5e-8 AS z, lo, span FROM x JOIN m ON m.col = x.col)
SELECT col, round(quantile_cont(x, 0.05), 5) AS x05, round(quantile_cont(x, 0.5), 5) AS x50, round(quantile_cont(x, 0.95), 5) AS x95, round(quantile_cont(z, 0.05), 5) AS z05, round(quantile_cont(z, 0.5), 5) AS z50,
 round(quantile_cont(z, 0.95), 5) AS z95, round(max(abs((z - 5e-8) * span + lo - x)), 5) AS error FROM z GROUP BY 1""")
def a20_diagnosis(spark, d):
    got = stats.diagnosis(b.sensors(spark, d), ["a", "b"])
    names = [F.col(c)[i].alias(f"{s}{p}") for c, s in (("raw", "x"), ("z", "z")) for i, p in enumerate(("05", "50", "95"))]
    return b.rounded(got.select("col", *names, "error"), 5)


@query()
def g08_merged(spark, d):
    """Patches below four cells joined to the neighbour of the longest border, over the whole grid."""
    shared_dir(spark)
    return grid.merged_small(grid.patches(b.cells(spark, d).withColumn("k", F.col("k") % 3), "k", 50), 4)
