"""Graph tables, samples, merges and calibrations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, spatial, stats
from ..shared import shuffled
from . import bindings as b
from .queries_rows import HAV
from .queries_sets import NB, H
from .registry import query


@query(f"WITH {b.DD} SELECT day, fid, round(coalesce(CASE WHEN n > 1 THEN delta END, 0), 6) AS v, CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END AS known, round(top, 6) AS top FROM dd WHERE fid % 10 <> 0", dates=("day",))
def gr02_source_nodes(spark, d):
    x = b.daily_obs(spark, d).withColumn("delta", F.when(F.col("n") > 1, F.col("delta")))
    out = graph.source_nodes(x, x.where(F.col("fid") % 10 == 0), ["delta", "top"])
    p = F.col("payload")
    return b.rounded(out.select("day", "fid", p[0].alias("v"), p[2].alias("known"), p[1].alias("top")))


@query(f"""WITH {b.DD}, {b.ST}, s AS (SELECT DISTINCT fid FROM st) SELECT s.fid, round(coalesce(obs, 0), 6) AS obs, CASE WHEN obs IS NULL THEN 0 ELSE 1 END AS present FROM s LEFT JOIN (SELECT * FROM dd WHERE day = DATE '2024-01-10') x ON x.fid = s.fid""")
def gr05_day_matrix(spark, d):
    out = graph.day_matrix(b.stations(spark, d), b.daily_obs(spark, d), F.to_date(F.lit("2024-01-10")), ["obs"])
    return b.rounded(out.select("fid", "obs", "present"))


@query(f"""WITH {b.DD}, {b.ST}, {NB}, n AS (SELECT day, fid, dense_rank() OVER (PARTITION BY day ORDER BY fid) - 1 AS local FROM dd WHERE fid % 10 <> 0)
SELECT a.day, CAST(a.local AS INT) AS s, CAST(z.local AS INT) AS d, round(km, 6) AS km FROM nb JOIN n a ON a.fid = src JOIN n z ON z.fid = dst AND z.day = a.day WHERE rank <= 8""", dates=("day",))
def gr07_graph_retrieval(spark, d):
    s, nodes = b.stations(spark, d), b.daily_obs(spark, d).select("day", "fid")
    e = spatial.neighbours(s, s, 8, 150.0).select("src", "dst", "km")
    e = e.join(shuffled(nodes.withColumnRenamed("fid", "src")), "src").select("day", "src", "dst", "km")
    _, out = graph.retrieved(nodes, e, nodes.where(F.col("fid") % 10 == 0))
    return b.rounded(out)


@query(f"""WITH {b.ST}, {NB}, x AS (SELECT src, list(dst ORDER BY rank) AS n FROM nb WHERE rank <= 6 GROUP BY 1) SELECT src, CAST(r AS INT) AS rank, n[least(r, len(n))] AS dst FROM x, range(1, 7) t(r)""")
def j15_padded_neighbours(spark, d):
    s = b.stations(spark, d)
    return graph.padded(spatial.neighbours(s, s, 6, 150.0), 6)


@query(f"""WITH {b.ST}, x AS (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON z.fid % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rank FROM x WHERE km <= 300)
SELECT src, CAST(rank AS INT) AS rank, CASE WHEN km > 60 THEN -1 ELSE dst END AS dst, round(CASE WHEN km > 60 THEN 0 ELSE km END, 6) AS km FROM r WHERE rank <= 4""")
def j17_pixel_index(spark, d):
    s = b.stations(spark, d)
    e = spatial.neighbours(s, s.where(F.col("fid") % 5 == 0), 4, 300.0, keep_self=True)
    return b.rounded(graph.with_sentinels(e, 60.0))


@query(f"""WITH {b.DD}, x AS (SELECT fid, day, {H("fid + date_diff('day', DATE '1970-01-01', day) * 17", 4)} AS h FROM dd), y AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h DESC, fid) AS r FROM x) SELECT fid, day FROM y WHERE h >= 0.6 * 100003 OR r = 1""", dates=("day",))
def s09_source_dropout(spark, d):
    return graph.dropped_sources(b.daily_obs(spark, d).select("fid", "day"), 0.6, 4)


@query(f"""WITH {b.ST}, x AS (SELECT fid, CAST(least(9, floor((lat - 42) / 7 * 10)) * 10 + least(9, floor((lon + 125) / 21 * 10)) AS BIGINT) AS tile, {H('fid', 8)} AS h FROM st), y AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY h, fid) AS p FROM x)
SELECT fid, tile FROM y ORDER BY CASE WHEN p <= 1 THEN 0 ELSE 1 END, h, fid LIMIT 110""")
def s11_tile_sample(spark, d):
    return graph.tile_sample(b.stations(spark, d), 110, 8, (-125.0, 42.0, -104.0, 49.0))


@query(f"""WITH {b.ST}, {NB}, e AS (SELECT src, dst, km, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS r FROM nb WHERE src % 3 = 0 AND dst % 3 = 0), k AS (SELECT src, count(*) AS n FROM e WHERE r <= 5 GROUP BY 1)
SELECT e.src AS fid, CAST(r - 1 AS INT) AS i, dst, round(km, 6) AS km FROM e JOIN k ON k.src = e.src WHERE r <= 5 AND n = 5""")
def s12_star_sample(spark, d):
    s = b.stations(spark, d)
    third = s.where(F.col("fid") % 3 == 0)
    out = graph.stars(third, spatial.neighbours(third, third, 5, 150.0).select("src", "dst", "km"), 5)
    out = out.select("fid", F.posexplode(F.arrays_zip("dst", "km")).alias("i", "p"))
    return b.rounded(out.select("fid", "i", F.col("p.dst").alias("dst"), F.col("p.km").alias("km")))


@query("SELECT l_orderkey AS k, l_linenumber AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey % 7 = 0")
def s13_systematic(spark, d):
    return b.table(spark, d, "lineitem").where(F.col("l_orderkey") % 7 == 0).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")).distinct()


@query(f"""WITH {b.DD}, x AS (SELECT DISTINCT day, {H("date_diff('day', DATE '1970-01-01', day)", 6)} AS h FROM dd), c AS (SELECT day FROM x ORDER BY h, day LIMIT 7) SELECT fid, day FROM dd WHERE day IN (SELECT day FROM c)""", dates=("day",))
def s14_day_groups(spark, d):
    x = b.daily_obs(spark, d).select("fid", "day")
    days = x.select("day").distinct().orderBy(stats.mixed_hash(F.unix_date("day"), 6), "day").limit(7)
    return x.join(days, "day", "left_semi")


@query(f"""WITH {b.DD}, x AS (SELECT fid, day AS start, {H("fid * 31 + date_diff('day', DATE '1970-01-01', day)", 2)} AS h FROM dd)
SELECT fid, start, coalesce(lead(start) OVER (PARTITION BY fid ORDER BY h, start), first_value(start) OVER (PARTITION BY fid ORDER BY h, start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS positive FROM x""", dates=("start", "positive"))
def s15_window_pairs(spark, d):
    return graph.window_pairs(b.daily_obs(spark, d).select("fid", F.col("day").alias("start")), "fid", "start", 2)


@query()
def s10_spaced_sample(spark, d):
    """Stations of which no two are closer than 40 km, greedy in hash order."""
    return graph.spaced_by_km(b.stations(spark, d), 40.0, 3)


@query("""WITH x AS (SELECT 'N' || c_nationkey || '_' || c_custkey % 40 AS fid, c_name AS name, c_acctbal / 200 AS lat, 0 AS list FROM customer UNION ALL SELECT 'N' || s_nationkey || '_' || s_suppkey % 40, s_name, s_acctbal / 200, 1 FROM supplier),
y AS (SELECT *, row_number() OVER w AS r, first_value(name) OVER w AS n1, first_value(lat) OVER w AS l1 FROM x WINDOW w AS (PARTITION BY fid ORDER BY list, name, lat))
SELECT CASE WHEN r = 1 THEN fid ELSE fid || '_' || list || '_' || r END AS fid, name, round(lat, 6) AS lat, list, r > 1 AS renamed FROM y WHERE r = 1 OR NOT (name = n1 OR abs(lat - l1) < 0.2)""")
def j31_station_merge(spark, d):
    c, s = b.table(spark, d, "customer"), b.table(spark, d, "supplier")
    one = c.select(F.concat(F.lit("N"), "c_nationkey", F.lit("_"), F.col("c_custkey") % 40).alias("fid"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 200).alias("lat"))
    two = s.select(F.concat(F.lit("N"), "s_nationkey", F.lit("_"), F.col("s_suppkey") % 40).alias("fid"), F.col("s_name").alias("name"), (F.col("s_acctbal") / 200).alias("lat"))
    return b.rounded(graph.merged_lists([one, two]))


@query(f"WITH {b.GR}, a AS (SELECT row, col, CASE WHEN k % 6 <> 0 THEN z END AS z FROM gr), c AS (SELECT row, col, CASE WHEN k % 7 <> 0 THEN z * 2 END AS z FROM gr WHERE row > 2) SELECT row, col, round(coalesce(CASE WHEN col < 25 THEN a.z ELSE c.z END, a.z, c.z), 6) AS z FROM a FULL JOIN c USING (row, col)")
def g23_mosaic(spark, d):
    g = b.cells(spark, d)
    west = g.select("row", "col", F.when(F.col("k") % 6 != 0, F.col("z")).alias("z"))
    east = g.where("row > 2").select("row", "col", F.when(F.col("k") % 7 != 0, F.col("z") * 2).alias("z"))
    return b.rounded(graph.mosaic(west, east, 25, "z"))


@query("SELECT CAST(p_partkey // 50 % 5 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, round(avg(p_retailprice), 6) AS z, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY 1, 2")
def g24_overlap_mean(spark, d):
    g = b.cells(spark, d).where("k % 4 <> 0").groupBy((F.col("row") % 5).alias("row"), "col")
    return b.rounded(g.agg(F.avg("z").alias("z"), F.count("*").alias("n")))


@query(f"""WITH {b.EV}, m AS (SELECT fid, month(day) AS month, avg(value) AS v, count(*) AS n FROM ev GROUP BY 1, 2) SELECT fid, month, round(v, 6) AS v, n FROM m""")
def a37_month_profiles(spark, d):
    return b.rounded(b.hourly(spark, d).groupBy("fid", F.month("day").alias("month")).agg(F.avg("value").alias("v"), F.count("*").alias("n")))


@query(f"""WITH {b.DD}, c AS (SELECT i AS cand, 0.031 + i * 0.01 AS b0 FROM range(6) t(i)), p AS (SELECT fid, cand, obs, 100 * (1 - 0.9 * exp(-(b0 + 0.201 * exp(-0.185 * 10)) * pow(abs(delta), 1.5))) AS q FROM dd, c),
s AS (SELECT fid, cand, sqrt(avg((q - obs) * (q - obs))) AS rmse FROM p GROUP BY 1, 2) SELECT fid, arg_min(cand, (rmse, cand)) AS cand, round(min(rmse), 5) AS rmse FROM s GROUP BY 1""")
def a38_calibration(spark, d):
    cand = spark.range(6).select(F.col("id").alias("cand"), (0.031 + F.col("id") * 0.01).alias("b0"))
    shape = F.col("b0") + 0.201 * F.exp(F.lit(-0.185 * 10))
    q = 100 * (1 - 0.9 * F.exp(-shape * F.pow(F.abs("delta"), F.lit(1.5))))
    out = graph.calibrated(b.daily_obs(spark, d), cand, q, "obs", "fid")
    return out.select("fid", "cand", F.round("rmse", 5).alias("rmse"))


@query(f"""WITH {b.DD}, {b.ST}, {NB} SELECT src % 10 = 0 AS held, count(*) AS n, round(avg(abs((a.base - z.base) - (a.obs - z.obs))), 6) AS mae FROM nb JOIN dd a ON a.fid = src JOIN dd z ON z.fid = dst AND z.day = a.day WHERE rank <= 16 GROUP BY 1""")
def a42_pair_skill(spark, d):
    s = b.stations(spark, d)
    e = spatial.neighbours(s, s, 16, 150.0).select("src", "dst")
    x = b.daily_obs(spark, d).select("fid", "day", "obs", "base")
    side = lambda n: x.select(F.col("fid").alias(n), "day", F.col("obs").alias(f"o_{n}"), F.col("base").alias(f"b_{n}"))
    out = e.join(shuffled(side("src")), "src").join(shuffled(side("dst")), ["dst", "day"])
    gap = F.abs((F.col("b_src") - F.col("b_dst")) - (F.col("o_src") - F.col("o_dst")))
    return b.rounded(out.groupBy((F.col("src") % 10 == 0).alias("held")).agg(F.count("*").alias("n"), F.avg(gap).alias("mae")))


@query("SELECT event_type AS source, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def a40_source_means(spark, d):
    e = b.hourly(spark, d)
    return b.rounded(e.groupBy(F.col("event_type").alias("source")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")))


@query(f"""WITH {b.GR}, w AS (SELECT r0, c0, count(*) AS n, sum(z) AS s FROM gr, (SELECT DISTINCT row // 4 * 4 AS r0 FROM gr) r, (SELECT DISTINCT col // 4 * 4 AS c0 FROM gr) c WHERE row >= r0 AND row < r0 + 8 AND col >= c0 AND col < c0 + 8 GROUP BY 1, 2)
SELECT CAST(r0 AS INT) AS r0, CAST(c0 AS INT) AS c0, n, round(s, 4) AS s FROM w""")
def j30_patch_windows(spark, d):
    """Cells inside each 8 x 8 patch on a stride of 4, up to the grid's ends: every cell goes to the patches that cover it."""
    g = b.cells(spark, d)
    cover = lambda c: F.filter(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.floor(F.col(c) / 4) - i) * 4), lambda x: x >= 0)
    p = g.select("z", F.explode(cover("row")).alias("r0"), "col").select("z", "r0", F.explode(cover("col")).alias("c0"))
    out = p.groupBy(F.col("r0").cast("int").alias("r0"), F.col("c0").cast("int").alias("c0")).agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    return out.select("r0", "c0", "n", F.round("s", 4).alias("s"))


@query(f"WITH {b.GR} SELECT a.row, a.col, round(z.z * 2 - a.z, 6) AS inc, CASE WHEN a.k % 3 = 0 THEN 0 ELSE 1 END AS valid FROM gr a JOIN gr z ON a.row = z.row AND a.col = z.col")
def g17_increments(spark, d):
    g = b.cells(spark, d)
    t = g.select("row", "col", (F.col("z") * 2).alias("t"))
    out = g.join(t, ["row", "col"])
    return b.rounded(out.select("row", "col", (F.col("t") - F.col("z")).alias("inc"), F.when(F.col("k") % 3 == 0, 0).otherwise(1).alias("valid")))


