"""Text that Spark writes from the tables and reads back, sinks read back, node tables and filled stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, halo, layers, spatial
from ..shared import shared_dir
from ..sources import grids, sinks, text
from . import bindings as b
from .queries_rows import HAV
from .queries_sets import NB
from .registry import query


def fresh(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def as_file(rows: DataFrame, folder: str, name: str) -> str:
    """rows(at, value), or a table as CSV with a header, as one file of that name.

    Rows are put in order by ranges; the task that writes the file only reads one after the other.
    """
    spark, draft = rows.sparkSession, f"{folder}/.draft-{name}"
    if rows.columns == ["at", "value"]:
        rows.orderBy("at").checkpoint().select("value").coalesce(1).write.text(draft)
    else:
        rows.coalesce(1).write.csv(draft, header=True)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    made = next(s.getPath() for s in system.listStatus(path(draft)) if s.getPath().getName().startswith("part-"))
    system.rename(made, path(f"{folder}/{name}"))
    return f"{folder}/{name}"


def headed(spark, rows: DataFrame, head: list[str]) -> DataFrame:
    """Lines (at, value) behind header lines."""
    top = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "at long, value string")
    return top.unionByName(rows.select(F.col("at").cast("long").alias("at"), "value"))


def station_lists(spark, d) -> list[str]:
    """Four lists of quoted ids behind three header lines, by nation."""
    c = b.table(spark, d, "customer")
    fid = F.lpad((F.col("c_custkey") % 700).cast("string"), 8, "0")
    rows = c.select("c_nationkey", F.col("c_custkey").alias("at"), F.concat(F.lit("'"), fid, F.lit("' "), "c_name").alias("value"))
    folder = fresh(spark, "lists")
    part = lambda i: headed(spark, rows.where(F.col("c_nationkey") % 4 == i), ["! list", "! of stations", "!"])
    return [as_file(part(i), folder, f"list_{i}.txt") for i in range(4)]


@query("SELECT DISTINCT lpad(CAST(c_custkey % 700 AS VARCHAR), 8, '0') AS fid FROM customer")
def src06_fixed_lists(spark, d):
    """Distinct ids of fixed-width lists behind their header lines."""
    return text.fixed_ids(spark, station_lists(spark, d), 3, 0, 10)


@query("SELECT DISTINCT lpad(CAST(c_custkey % 700 AS VARCHAR), 8, '0') AS fid FROM customer WHERE c_nationkey % 4 IN (0, 1, 3)")
def src07_profiles(spark, d):
    """The ids of all lists that two named profiles use."""
    lists = station_lists(spark, d)
    known = {"winter": [lists[3], lists[0]], "summer": [lists[1], lists[3]], "fall": [lists[2]]}
    return text.fixed_ids(spark, text.profile_files([" Winter", "SUMMER "], known), 3, 0, 10)


@query("""WITH x AS (SELECT user_id % 3 AS file, date_trunc('minute', ts) AS ts, event_id, CAST(event_id * 37 % 360 AS DOUBLE) AS wdir, CAST(floor(value) AS DOUBLE) AS wind, CAST(980 + event_id % 40 AS DOUBLE) AS p FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY file, ts ORDER BY event_id) AS r FROM x)
SELECT file, CAST(epoch(ts) AS BIGINT) AS at, CASE WHEN wdir NOT IN (99, 999, 9999) THEN wdir END AS wdir, CASE WHEN wind NOT IN (99, 999, 9999) THEN wind END AS wind, CASE WHEN file <> 2 AND p NOT IN (99, 999, 9999) THEN p END AS pressure FROM r WHERE r = 1""")
def src09_buoys(spark, d):
    """Buoy text of three files whose headers differ; the first row of a minute stays."""
    e, folder = b.table(spark, d, "events"), fresh(spark, "buoys")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy MM dd HH mm")
    wdir, wind, p = (F.col("event_id") * 37 % 360).cast("string"), F.floor("value").cast("string"), (980 + F.col("event_id") % 40).cast("string")
    heads = {0: ("#YY  MM DD hh mm WDIR WSPD PRES", [wdir, wind, p]), 1: ("YYYY MM DD hh mm WSPD  PRES WDIR", [wind, p, wdir]), 2: ("#YY MM DD hh mm WSPD WDIR", [wind, wdir])}
    paths = []
    for i, (head, parts) in heads.items():
        rows = e.where(F.col("user_id") % 3 == i).select(F.col("event_id").alias("at"), F.concat_ws("  ", stamp, *parts).alias("value"))
        paths.append(as_file(headed(spark, rows, [head]), folder, f"buoy_{i}.txt"))
    out = text.buoy(spark, paths)
    file = F.regexp_extract("file", r"buoy_(\d)", 1).cast("long")
    return out.select(file.alias("file"), F.unix_timestamp("ts").alias("at"), "wdir", "wind", "pressure")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderstatus END AS status, year(o_orderdate) AS year FROM orders)
SELECT year, count(*) AS n, round(sum(price), 2) AS total, count(status) AS with_status, min(k) AS low FROM o GROUP BY 1""")
def src11_drifting(spark, d):
    """Yearly CSV files, of which every second one has a column more; the year comes from the name."""
    o, folder = b.table(spark, d, "orders"), fresh(spark, "yearly")
    years = [r[0] for r in o.select(F.year("o_orderdate")).distinct().collect()]
    paths = []
    for y in sorted(years):
        columns = [F.lit("x").alias("system:index"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.lit("{}").alias(".geo")]
        columns += [F.col("o_orderstatus").alias("status")] if y % 2 == 0 else []
        paths.append(as_file(o.where(F.year("o_orderdate") == y).select(*columns), folder, f"bands_{y}.csv"))
    t = text.drifting_csv(spark, paths)
    out = t.groupBy("year").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.count("status").alias("with_status"), F.min("k").cast("long").alias("low"))
    return b.rounded(out, 2)


@query("""SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, CASE WHEN event_id % 5 > 0 THEN 'C' || lpad(CAST(event_id % 16 AS VARCHAR), 2, '0') END AS channel, count(*) AS n FROM events GROUP BY 1, 2, 3""", dates=("day",))
def src16_names(spark, d):
    """Day, hour and channel from the names of files."""
    ts = F.col("ts").cast("timestamp")
    channel = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("_C"), F.lpad((F.col("event_id") % 16).cast("string"), 2, "0"))).otherwise(F.lit("_all"))
    name = F.concat(F.lit("gs://archive/19990101/grid."), F.date_format(ts, "yyyyMMdd"), F.lit(".t"), F.date_format(ts, "HH"), F.lit("z"), channel, F.lit(".tif"))
    out = text.name_facts(b.table(spark, d, "events").select(name.alias("file")))
    return out.groupBy("day", "hour", "channel").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey % 3 AS file, o_orderkey AS msg, o_orderkey * 1000 + o_custkey AS first, coalesce(lead(o_orderkey * 1000 + o_custkey) OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1, -1) AS last,
 CASE WHEN o_orderstatus = 'F' THEN 'TMP' ELSE 'DPT' END AS var FROM orders""")
def src18_byte_ranges(spark, d):
    """The byte range of every message of three inventories."""
    o, folder = b.table(spark, d, "orders"), fresh(spark, "inventories")
    var = F.when(F.col("o_orderstatus") == "F", F.lit("TMP")).otherwise(F.lit("DPT"))
    line = F.concat_ws(":", "o_orderkey", F.col("o_orderkey") * 1000 + F.col("o_custkey"), F.lit("d=2024010100"), var, F.lit("2 m above ground"), F.lit("anl"), F.lit(""))
    rows = o.select("o_orderkey", F.col("o_orderkey").alias("at"), line.alias("value"))
    paths = [as_file(rows.where(F.col("o_orderkey") % 3 == i).drop("o_orderkey"), folder, f"inventory_{i}.idx") for i in range(3)]
    out = text.byte_ranges(spark, paths)
    return out.select(F.regexp_extract("file", r"inventory_(\d)", 1).cast("long").alias("file"), F.col("msg").cast("long").alias("msg"), "first", "last", "var")


@query(f"""WITH {b.DD}, {b.ST} SELECT st.fid, elev, count(*) AS n, round(avg(obs), 6) AS obs, min(day) AS a, max(day) AS z FROM dd JOIN st ON st.fid = dd.fid GROUP BY 1, 2""", dates=("a", "z"))
def snk01_bucketed(spark, d):
    """A bucketed station-day table joined with bucketed stations and grouped, without an exchange."""
    name, path = f"days_{uuid.uuid4().hex}", fresh(spark, "bucketed")
    days = sinks.write_bucketed(b.daily_obs(spark, d).select("fid", "day", "obs"), f"{name}_d", f"{path}/days", 8, ["fid"], ["day"])
    places = sinks.write_bucketed(b.stations(spark, d).select("fid", "elev"), f"{name}_s", f"{path}/stations", 8, ["fid"])
    out = days.join(places.hint("merge"), "fid").groupBy("fid", "elev")
    return b.rounded(out.agg(F.count("*").alias("n"), F.avg("obs").alias("obs"), F.min("day").alias("a"), F.max("day").alias("z")))


@query(f"""WITH {b.DD} SELECT fid, count(*) AS n, round(sum(CASE WHEN fid % 4 = 0 THEN obs * 2 ELSE obs END), 4) AS total FROM dd GROUP BY 1""")
def snk02_by_station(spark, d):
    """A folder a station; a second write replaces a quarter of the stations and leaves the others."""
    path, x = fresh(spark, "split"), b.daily_obs(spark, d).select("fid", "day", "obs").checkpoint()
    sinks.write_by_station(x, path)
    sinks.write_by_station(x.where(F.col("fid") % 4 == 0).withColumn("obs", F.col("obs") * 2), path)
    back = spark.read.schema("day date, obs double, fid long").parquet(path)
    return b.rounded(back.groupBy("fid").agg(F.count("*").alias("n"), F.sum("obs").alias("total")), 4)


@query(f"""WITH {b.SE} SELECT channel, count(*) AS n, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS std, round(min(b), 6) AS low FROM se GROUP BY 1""")
def snk08_artifact(spark, d):
    """Statistics of each channel as a JSON artifact, read back with their schema."""
    g = b.sensors(spark, d).groupBy("channel")
    stats = g.agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.stddev_samp("a").alias("std"), F.min("b").alias("low"))
    path = fresh(spark, "artifact")
    sinks.write_artifact(spark, stats, path)
    return b.rounded(spark.read.schema(stats.schema).json(path))


@query(f"""WITH {b.DD}, {b.ST}, {NB}, i AS (SELECT src, z.day, avg(z.delta) AS m, stddev_pop(z.delta) AS s, count(*) AS c FROM nb JOIN dd z ON z.fid = dst WHERE rank <= 6 AND dst % 10 <> 0 GROUP BY 1, 2)
SELECT dd.day, dd.fid, round(obs, 5) AS obs, round(base, 5) AS base, 0.0 AS gust, elev, round(bal, 2) AS bal, round(coalesce(m, 0), 5) AS near_mean, round(coalesce(s, 0), 5) AS near_std, CAST(coalesce(c, 0) AS DOUBLE) AS near_n,
 round(sin(2 * pi() * dayofyear(dd.day) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(dd.day) / 365.25), 6) AS doy_cos, round(lat, 5) AS lat, round(lon, 5) AS lon,
 round(CASE WHEN abs(delta) <= 40 THEN delta ELSE 0 END, 5) AS y0, round(CASE WHEN n > 1 AND abs(top) <= 40 THEN top ELSE 0 END, 5) AS y1, abs(delta) <= 40 AS s0, n > 1 AND abs(top) <= 40 AS s1
FROM dd JOIN st ON st.fid = dd.fid LEFT JOIN i ON i.src = dd.fid AND i.day = dd.day""", dates=("day",))
def gr01_node_table(spark, d):
    """Features, targets and supervision of every node of every day."""
    s = b.stations(spark, d)
    x = b.daily_obs(spark, d).withColumn("top", F.when(F.col("n") > 1, F.col("top")))
    edges = spatial.neighbours(s, s, 6, 150.0).select("src", "dst")
    out = graph.node_table(x, s, edges, s.where(F.col("fid") % 10 == 0), ["obs", "base", "gust"], ["elev", "bal"], ["delta", "top"], 40.0)
    names = ["obs", "base", "gust", "elev", "bal", "near_mean", "near_std", "near_n", "doy_sin", "doy_cos", "lat", "lon"]
    places = {"bal": 2, "doy_sin": 6, "doy_cos": 6}
    return out.select(
        "day", "fid", *[F.round(F.col("x")[i], places.get(n, 5)).alias(n) for i, n in enumerate(names)],
        *[F.round(F.col("y")[i], 5).alias(f"y{i}") for i in (0, 1)], *[F.col("supervised")[i].alias(f"s{i}") for i in (0, 1)],
    )


@query(f"""WITH {b.DD}, {b.ST}, k AS (SELECT src, dst, km, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS place FROM (SELECT a.fid AS src, z.fid AS dst, {HAV.format(a='a', d='z')} AS km FROM st a JOIN st z ON a.fid <> z.fid) WHERE km <= 40),
near AS (SELECT src AS fid, dst, place, km FROM k WHERE place <= 6), rec AS (SELECT fid AS dst, row_number() OVER (ORDER BY count(*) DESC, fid) AS h FROM dd GROUP BY fid QUALIFY h <= 8),
c AS (SELECT st.fid, count(near.dst) AS has FROM st LEFT JOIN near ON near.fid = st.fid GROUP BY 1),
fill AS (SELECT c.fid, rec.dst, has + row_number() OVER (PARTITION BY c.fid ORDER BY h) AS spot FROM c JOIN rec ON rec.dst <> c.fid LEFT JOIN near ON near.fid = c.fid AND near.dst = rec.dst WHERE has < 6 AND near.dst IS NULL QUALIFY spot <= 6),
e AS (SELECT fid, dst, place, false AS filler, km FROM near UNION ALL SELECT fid, dst, spot, true, 0 FROM fill),
w AS (SELECT fid, day, list(struct_pack(v := obs, o := top)) OVER (PARTITION BY fid ORDER BY day ROWS 2 PRECEDING) AS w, min(day) OVER (PARTITION BY fid ORDER BY day ROWS 2 PRECEDING) AS a FROM dd),
q AS (SELECT * FROM w WHERE len(w) = 3 AND day - a = 2)
SELECT dd.fid, dd.day, CAST(e.place AS INT) AS place, e.dst, filler, round(km, 5) AS km, q.fid IS NOT NULL AS known, round(coalesce(w[3].v, 0), 5) AS today, round(coalesce(w[1].v + 10 * w[1].v + 100 * w[2].v, 0), 4) AS lagged,
 round(coalesce(w[1].o + 10 * w[2].o + 100 * w[3].o, 0), 4) AS outer_seq, round(dd.top - coalesce(w[3].o, 0), 5) AS outer_delta FROM dd JOIN e ON e.fid = dd.fid LEFT JOIN q ON q.fid = e.dst AND q.day = dd.day""", dates=("day",))
def j39_filled_stars(spark, d):
    """Six neighbours of each station and day, filled from the longest records, with lagged values of three days."""
    s, x = b.stations(spark, d), b.daily_obs(spark, d)
    stars = layers.filled_stars(spatial.neighbours(s, s, 6, 40.0), s, x.groupBy("fid").agg(F.count("*").alias("days")), 6, 8)
    out = layers.star_samples(x, stars, x, "obs", ["top"], 3)
    weigh = lambda c: F.col(c)[0] + 10 * F.col(c)[1] + 100 * F.col(c)[2]
    return out.select(
        "fid", "day", F.col("place").cast("int").alias("place"), "dst", "filler", F.round("km", 5).alias("km"), "known", F.round("today", 5).alias("today"),
        F.round(weigh("lagged"), 4).alias("lagged"), F.round(weigh("top_seq"), 4).alias("outer_seq"), F.round("top_delta", 5).alias("outer_delta"),
    )


AZIMUTHS, DISTANCES = [22.5 * i for i in range(16)], [2000.0, 10_000.0]
_RAYS = ", ".join(str(x) for x in halo.ray_steps(AZIMUTHS, DISTANCES, 1000.0))
_SX = ", ".join(f"round(coalesce(max(s) FILTER (az = {i} AND reach <= {j}), 0), 6) AS sx_{int(a):03d}_{int(x) // 1000}k" for i, a in enumerate(AZIMUTHS) for j, x in enumerate(DISTANCES))


@query(f"""WITH {b.GR}, o AS (SELECT * FROM (VALUES {_RAYS}) t(az, reach, dr, dc, d)),
m AS (SELECT g.row, g.col, az, reach, max((n.z - g.z) / d) AS s FROM gr g JOIN o ON true JOIN gr n ON n.row = g.row + dr AND n.col = g.col + dc GROUP BY 1, 2, 3, 4)
SELECT gr.row, gr.col, {_SX} FROM gr LEFT JOIN m ON m.row = gr.row AND m.col = gr.col GROUP BY 1, 2""")
def g14_shelter_sectors(spark, d):
    """Shelter of every cell in 16 sectors of three rays, up to 2 and 10 km."""
    out = halo.shelter(b.cells(spark, d).select("row", "col", "z"), "z", 1000.0, AZIMUTHS, DISTANCES)
    return b.rounded(out.drop("z"))


@query(f"""WITH {b.EV}, e AS (SELECT max(day) - 9 AS a FROM ev) SELECT day, CAST(fid // 50 AS INT) AS row, CAST(fid % 50 AS INT) AS col, round(avg(value), 6) AS tmp_net, CAST(count(*) AS DOUBLE) AS n_net FROM ev, e WHERE day >= a GROUP BY 1, 2, 3""", dates=("day",))
def x01_grid_source(spark, d):
    """The last ten days of a daily grid, read through the data source, which leaves out the other days."""
    h, path = b.hourly(spark, d), fresh(spark, "grid")
    cells = h.groupBy("day", F.floor(F.col("fid") / 50).cast("int").alias("row"), (F.col("fid") % 50).cast("int").alias("col"))
    cells.agg(F.avg("value").alias("TMP"), F.count("*").cast("double").alias("N")).repartition("day").write.partitionBy("day").parquet(path)
    spark.dataSource.register(grids.GridSource)
    first = h.agg(F.date_sub(F.max("day"), 9).alias("a")).first().a
    out = spark.read.format("daily_grid").options(path=path, product="net", columns="TMP=tmp,N=n", first=first.isoformat()).load()
    return b.rounded(out)


@query("""WITH x AS (SELECT o_custkey % 20 AS fid, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2), w AS (SELECT *, year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END AS wy FROM x)
SELECT fid, day, round(x * 25.4 - coalesce(lag(x * 25.4) OVER (PARTITION BY fid, wy ORDER BY day), 0), 3) AS prec FROM w""", dates=("day",))
def src20_water_years(spark, d):
    """Daily amounts from tables of water years by day and month."""
    o = b.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("fid"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("x"))
    wy = F.year("day") + (F.month("day") >= 10).cast("int")
    o = o.withColumn("m", F.date_format("day", "MMM"))
    table = o.groupBy("fid", wy.alias("wy"), F.dayofmonth("day").alias("d")).pivot("m", text.MONTHS).agg(F.sum("x"))
    return b.rounded(text.water_years(table, "fid", "prec", "inch", cumulative=True), 3)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS fid, round(42 + c_custkey % 7, 6) AS latitude, round(-120 + c_custkey % 11 / 2.0, 6) AS longitude, c_acctbal AS slope, CAST(c_nationkey AS DOUBLE) AS elevation FROM customer""")
def src25_station_attributes(spark, d):
    """Attributes of all stations from four tile files."""
    c, folder = b.table(spark, d, "customer"), fresh(spark, "tiles")
    k = F.col("c_custkey")
    t = c.select(k.alias("fid"), (42 + k % 7).alias("MGRS_Y"), (-120 + k % 11 / 2).alias("MGRS_X"), F.col("c_acctbal").alias("slope"), F.col("c_nationkey").alias("elevation"), F.lit("x").alias("other"), "c_nationkey")
    files = [as_file(t.where(F.col("c_nationkey") % 4 == i).drop("c_nationkey"), folder, f"tile_{i}.csv") for i in range(4)]
    return b.rounded(text.station_attributes(spark, files, "fid", ["slope", "elevation"], ("MGRS_Y", "MGRS_X")))


@query(f"""WITH {b.EV}, l AS (SELECT max(day) AS last FROM ev), c AS (SELECT day, fid, avg(value) * CASE WHEN day = last THEN 2 ELSE 1 END AS obs FROM ev, l WHERE event_type = 'click' GROUP BY day, fid, last), w AS (SELECT day, fid, avg(value) AS obs, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY 1, 2)
SELECT w.day, CAST(w.fid // 50 AS INT) AS row, CAST(w.fid % 50 AS INT) AS col, round(coalesce(c.obs, w.obs), 6) AS obs, n, CAST(1 AS BIGINT) AS built FROM w LEFT JOIN c ON c.day = w.day AND c.fid = w.fid""", dates=("day",))
def g25_layer_refresh(spark, d):
    """A layer of two sources, built twice: the second run finds one day changed and builds that one alone."""
    h = b.hourly(spark, d)
    place = [F.floor(F.col("fid") / 50).cast("int").alias("row"), (F.col("fid") % 50).cast("int").alias("col")]
    clicks = h.where("event_type = 'click'").groupBy("day", *place).agg(F.avg("value").alias("obs"), F.lit(None).cast("double").alias("n")).checkpoint()
    every = h.groupBy("day", *place).agg(F.avg("value").alias("obs"), F.count("*").cast("double").alias("n")).checkpoint()
    layer = grids.DayLayer(spark, fresh(spark, "layer"), ["obs", "n"])
    layer.build([clicks, every])
    last = h.agg(F.max("day").alias("z")).first().z
    changed = clicks.withColumn("obs", F.when(F.col("day") == F.lit(last), F.col("obs") * 2).otherwise(F.col("obs")))
    built = layer.build([changed, every])
    return b.rounded(layer.read().join(built.agg(F.count("*").alias("built"))))
