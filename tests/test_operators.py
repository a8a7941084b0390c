"""Operators on small fixtures."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from isohyet.functions import geo, met
import isohyet.plans.queries_io
import isohyet.plans.queries_sets  # noqa: F401
from isohyet.operators import climatology, graph, grid, layers, qc, series, spatial, stats
from isohyet.operators.quantiles import quantiles
from isohyet.plans import registry
from isohyet.sources import sinks, text
from isohyet.streaming import streams


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_wind_round_trip(spark):
    u, v = met.wind_uv(F.lit(7.0), F.lit(225.0))
    r = one(spark, u=u, v=v, d=met.wind_from(u, v), s=met.wind_speed(u, v))
    assert (round(r.d, 6), round(r.s, 6)) == (225.0, 7.0)
    par, perp = met.wind_residuals(F.lit(5.0), F.lit(1.0), F.lit(3.0), F.lit(4.0))
    back = met.wind_from_residuals(par, perp, F.lit(3.0), F.lit(4.0))
    r = one(spark, u=back[0], v=back[1])
    assert (round(r.u, 9), round(r.v, 9)) == (5.0, 1.0)


def test_calm_direction_as_in_sql(spark, duck):
    """Zeros of either sign; a calm day among others."""
    rows = [(i, dt.datetime(2024, 1, 1, i), u, v) for i, (u, v) in enumerate([(0.0, 0.0), (0.0, -0.0), (-0.0, 0.0), (-0.0, -0.0), (0.0, 2.0), (-1.0, 0.0)])]
    df = spark.createDataFrame(rows, "fid long, ts timestamp, u double, v double")
    got = {r.fid: r.d for r in df.select("fid", met.wind_from(F.col("u"), F.col("v")).alias("d")).collect()}
    by_day = {r.fid: r.wdir for r in series.vector_daily(df, "fid", "ts", "u", "v").collect()}
    for i, _, u, v in rows:
        a, b = duck.execute("SELECT degrees(atan2(-u, -v)), degrees(atan2(-avg(u), -avg(v))) FROM (SELECT CAST(? AS DOUBLE) u, CAST(? AS DOUBLE) v) GROUP BY u, v", [u, v]).fetchone()
        assert (got[i], by_day[i]) == (a + 360 if a < 0 else a, b + 360 if b < 0 else b)


def test_vapour_pressure_inverse(spark):
    r = one(spark, t=met.dew_point(met.vapour_pressure(F.lit(12.5))), q=met.ea_from_q(met.q_from_ea(F.lit(1.2), F.lit(90.0)), F.lit(90.0)))
    assert abs(r.t - 12.5) < 1e-9 and abs(r.q - 1.2) < 1e-9


def test_reference_et_is_plausible(spark):
    a = [F.lit(float(x)) for x in (30, 14, 1.4, 25, 2, 500, 42, 190)]
    assert 4 < one(spark, et=met.reference_et(*a)).et < 9


def test_edge_angles(spark):
    r = one(spark, a=geo.facet_alignment(*[F.lit(float(x)) for x in (0, 1, 0, 1)]), o=geo.facet_alignment(*[F.lit(float(x)) for x in (0, 1, 0, -1)]),
            f=geo.facet_alignment(*[F.lit(float(x)) for x in (0, 0, 0, 1)]), n=geo.bearing_degrees(*[F.lit(float(x)) for x in (0, 0, 1, 0)]),
            x=geo.at_direction(F.array(*[F.lit(float(i)) for i in range(16)]), 16, F.lit(33.75)), d=geo.dms(F.lit("12°30'36\"W")))
    assert (r.a, r.o, r.f, r.n, r.x, round(r.d, 6)) == (1.0, -1.0, 0.0, 0.0, 1.5, -12.51)


def test_quantile_map_keeps_nulls_and_ends(spark):
    xs, ys = F.array(*[F.lit(float(x)) for x in (100, 200, 300, 400)]), F.array(*[F.lit(float(x)) for x in (105, 205, 305, 405)])
    m = lambda v: geo.quantile_map(F.lit(v).cast("double"), xs, ys)
    r = one(spark, a=m(250.0), lo=m(1.0), hi=m(999.0), n=m(None), none=geo.quantile_map(F.lit(5.0), F.lit(None).cast("array<double>"), ys))
    assert (r.a, r.lo, r.hi, r.n, r.none) == (255.0, 105.0, 405.0, None, 5.0)


def test_leap_day_and_periods(spark):
    day = lambda s: F.to_date(F.lit(s))
    r = one(spark, a=geo.doy365(day("2024-02-29")), b=geo.doy365(day("2024-03-01")), c=geo.doy365(day("2023-12-31")), d=geo.doy365(day("2024-12-31")), p=geo.period(day("2024-07-15")))
    assert (r.a, r.b, r.c, r.d, r.p) == (60, 60, 365, 365, 3)


def test_nan_becomes_null_and_leaks_go(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 4.0)], "fid int, dew_x double")
    assert [r.dew_x for r in qc.nan_to_null(df).orderBy("fid").collect()] == [None, None, 4.0]
    assert qc.without_leaks(df).columns == ["fid"] and qc.without_leaks(df, ["dew_x"]).columns == ["fid", "dew_x"]


def test_baseline_guard_raises(spark):
    df = spark.createDataFrame([(1.0, "urma"), (2.0, "other")], "delta double, source string")
    with pytest.raises(Exception, match="baseline"):
        qc.assert_baseline(df, "delta", "source", ["urma"]).collect()


@pytest.mark.parametrize("r", [20.0, 400.0])
def test_within_against_brute_force(spark, r):
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(84, 90, 40), rng.uniform(-1, 1, 60)])
    lon = np.concatenate([rng.uniform(-180, 180, 190), np.where(rng.random(60) < 0.5, 179.95, -179.95) + rng.uniform(-0.04, 0.04, 60)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "fid long, lat double, lon double")
    got = {(x.src, x.dst) for x in spatial.within(df, df, r).collect()}
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))
    np.fill_diagonal(km, 1e9)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(km <= r), strict=True)}


def test_within_beyond_a_pole(spark):
    """Latitudes that go on beyond a pole mean the place on its other side, as in the distance."""
    rows = [(1, 89.9, 10.0), (2, 90.1, 10.0), (3, 89.9, -170.0), (4, 44.0, -120.0), (5, 404.0, -120.0), (6, 136.0, 60.0), (7, -270.0, 3.0)]
    df = spark.createDataFrame(rows, "fid long, lat double, lon double")
    got = {(x.src, x.dst) for x in spatial.within(df, df, 30.0).collect()}
    groups = [{1, 2, 3, 7}, {4, 5, 6}]
    assert got == {(a, b) for g in groups for a in g for b in g if a != b}


def test_neighbours_send_no_side_through_the_driver(spark, tmp_path):
    """Files whose estimated size is below the limit of a broadcast."""
    spark.range(500).selectExpr("id fid", "42 + id * 0.01d lat", "-120 + id * 0.01d lon").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    day = df.select("fid", F.current_date().alias("day"), F.col("lat").alias("d"))
    for made in (spatial.within(df, df, 20.0), stats.innovations(day, spatial.neighbours(df, df, 2), df.select("fid"), ["d"]), spatial.not_near(df, df, 5.0)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_queries_of_neighbours_send_no_side_through_the_driver(spark):
    """No join of these is by a broadcast of a side that grows with the input, though the tables are small."""
    for name in ("j11_knn_graph", "g22_graph_checks", "j25_grid_edges"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def _broadcast_rows(spark, first):
    """Rows of each side that was broadcast by the executions from number ``first`` on, rounds among them."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run >= first:
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if node.name().startswith("BroadcastExchange"):
                    metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                    rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return rows


@pytest.mark.parametrize("name", ["flagship_residuals", "gr01_node_table", "gr03_station_graph", "j35_usable_edges", "j39_filled_stars", "j40_same_day_neighbours", "j20_pairs", "snk07_satellite_features", "g20_cells_in_radius", "a39_split_audit", "j02_station_day"])
def test_whole_run_broadcasts_days_at_most(spark, name):
    """No step of the whole run, rounds of neighbours among them, broadcasts more than the 30 days' means."""
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1) + 1
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert max(_broadcast_rows(spark, first), default=0) <= 30


def test_adjacency_carries_values(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, None)], "row int, col int, z double")
    got = {tuple(r) for r in grid.adjacency(df, values=["z"]).collect()}
    assert got == {(0, 0, 0, 1, 1.0, 2.0), (0, 1, 0, 0, 2.0, 1.0), (0, 1, 1, 1, 2.0, None), (1, 1, 0, 1, None, 2.0)}
    assert {tuple(r) for r in grid.adjacency(df).collect()} == {g[:4] for g in got}


def test_far_places_go_through_the_tree(spark):
    """Nearest points of places on the whole sphere, with and without heights, as by brute force."""
    rng = np.random.default_rng(5)
    points = [(i, float(rng.uniform(42, 44)), float(rng.uniform(-121, -119)), float(rng.uniform(0, 30))) for i in range(400)]
    points += [(i + 400, *points[i][1:]) for i in range(5)]  # some twice
    places = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), 0.0) for i in range(60)] + [(60, 90.0, 0.0, 0.0), (61, 43.0, -120.0, 1.0), (62, 403.0, -120.0, 0.0)]
    for flat in (True, False):
        up = (lambda h: 0.0) if flat else (lambda h: h)
        a = spark.createDataFrame([(i, la, lo, up(h)) for i, la, lo, h in places], "src long, lat1 double, lon1 double, down double")
        z = spark.createDataFrame([(i, la, lo, up(h)) for i, la, lo, h in points], "dst long, lat2 double, lon2 double, up double")
        got = {}
        for r in spatial.descended(a, z, 4).collect():
            got.setdefault(r.src, []).append((r["rank"], round(r.km, 4)))
        for i, la, lo, h in places:
            want = sorted(math.hypot(_km(la, lo, x, y), up(h) - up(e)) for _, x, y, e in points)[:4]
            assert sorted(got[i]) == [(n, pytest.approx(km, abs=2e-4)) for n, km in enumerate(want, 1)]


def test_spaced_without_pairs(spark):
    """As the greedy choice over all pairs."""
    df = spark.range(300).selectExpr("id fid", "42 + (id * 7919 % 1009) / 500d lat", "-120 + (id * 104729 % 2003) / 700d lon")
    df = df.unionByName(spark.createDataFrame([(900, None, 1.0)], "fid long, lat double, lon double"))
    want = graph.spaced(df, spatial.within(df, df, 40.0), 3)
    assert sorted(r.fid for r in graph.spaced_by_km(df, 40.0, 3).collect()) == sorted(r.fid for r in want.collect())


def test_innovations_leave_holdout_out(spark):
    day = dt.date(2024, 1, 1)
    table = spark.createDataFrame([(1, day, 1.0), (2, day, 3.0), (3, day, 100.0), (4, day, None)], "fid long, day date, d double")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1), (3, 1)], "src long, dst long")
    held = spark.createDataFrame([(3,)], "fid long")
    out = {r.fid: (r.inn_d_mean, r.inn_d_std, r.inn_d_n) for r in stats.innovations(table, edges, held, ["d"]).collect()}
    assert out == {1: (3.0, 0.0, 1), 2: (1.0, 0.0, 1), 3: (1.0, 0.0, 1), 4: (None, None, 0)}


def test_split_sizes_and_roles(spark):
    s = spark.range(101).withColumnRenamed("id", "fid")
    n = {r.split: r["count"] for r in stats.station_split(s, 0.8, 1).groupBy("split").count().collect()}
    assert n == {"train": 81, "val": 20}
    rows = s.withColumn("day", F.to_date(F.lit("2024-01-01")))
    roles = {r.role: r["count"] for r in stats.source_query_split(rows, s.where("fid < 11"), 0.5, 2).groupBy("role").count().collect()}
    assert roles == {"holdout": 11, "source": 45, "query": 45}


def cells(spark, f, n=12):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(n) for c in range(n)], "row int, col int, z double")


def test_slope_of_planes(spark):
    south = grid.slope_aspect(cells(spark, lambda r, c: r * 10), "z", 10.0).where("row between 1 and 10 and col between 1 and 10").collect()
    east = grid.slope_aspect(cells(spark, lambda r, c: -c * 10), "z", 10.0).where("row between 1 and 10 and col between 1 and 10").collect()
    flat = grid.slope_aspect(cells(spark, lambda r, c: 5), "z", 10.0).collect()
    assert {round(x.aspect) % 360 for x in south} == {0} and {round(x.aspect) for x in east} == {90}
    assert {x.aspect for x in flat} == {-1.0} and all(abs(x.slope - 45) < 1e-9 for x in south)


def test_patches_and_merge(spark):
    df = cells(spark, lambda r, c: 1 if (r < 3 and c < 3) or (r > 8 and c > 8) else 0)
    out = grid.patches(df, "z", 12)
    sizes = {(r.z, r["count"]) for r in out.groupBy("z", "patch").count().collect()}
    assert sizes == {(1.0, 9), (0.0, 126)}
    assert grid.merged_small(out, 10).select("patch").distinct().count() == 1


def test_constant_fields_stay(spark):
    df = cells(spark, lambda r, c: 7)
    assert {round(x.z_focal, 9) for x in grid.focal(df, grid.disc(3), "z").collect()} == {7.0}
    assert {round(x.tpi, 9) for x in grid.position_index(df, "z", 2).collect()} == {0.0}


def test_harmonics_recover_a_cycle(spark):
    rows = [(1, d, 10 + 3 * math.sin(2 * math.pi * d / 365)) for d in range(1, 366)] + [(2, d, 1.0) for d in (1, 2, 3)]
    out = climatology.harmonics(spark.createDataFrame(rows, "fid long, doy int, v double"), "fid", "doy", "v").collect()
    assert len(out) == 1 and np.allclose(out[0].coef, [10, 3, 0, 0, 0], atol=1e-6) and out[0].r2 > 0.999999


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 4 + x @ [2, -1] + rng.normal(size=60) * 0.1
    w = climatology.ridge(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"], "y", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(w[1:], np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc))


def test_interpolation_ends(spark):
    rows = [(1, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])]
    out = series.interpolate(spark.createDataFrame(rows, "fid long, i int, v double"), "fid", "i", "v").orderBy("i").collect()
    assert [r.v for r in out] == [None, 1.0, 2.0, 3.0, 3.0]


def test_text_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("head\n'KABC1234' x\n\nKDEF 99\nKDEF 99\n")
    assert {r.fid for r in text.fixed_ids(spark, str(tmp_path / "list.txt"), 1, 0, 9).collect()} == {"KABC1234", "KDEF 99"}
    (tmp_path / "a.idx").write_text("1:0:d=20240101:TMP:2 m:anl\n2:500:d=20240101:DPT:2 m:anl\n")
    assert [(r.msg, r.first, r["last"]) for r in text.byte_ranges(spark, str(tmp_path / "a.idx")).orderBy("msg").collect()] == [(1, 0, 499), (2, 500, -1)]
    (tmp_path / "b.txt").write_text("#YY MM DD hh mm WDIR WSPD\n2020 01 02 03 00 120 99.0\n2020 01 02 03 00 130 5.0\n2020 01 02 04 00 999 7.5\n")
    out = text.buoy(spark, str(tmp_path / "b.txt"), ["WDIR", "WSPD"]).orderBy("ts").collect()
    assert [(r.wdir, r.wind) for r in out] == [(120.0, None), (None, 7.5)]
    assert text.profile_files([" A ", "b"], {"a": ["1", "2"], "b": ["2", "3"]}) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        text.profile_files(["z"], {})
    df = spark.createDataFrame([("x/rtma_20240203_t05z_C13.tif",)], "file string")
    r = text.name_facts(df).first()
    assert (str(r.day), r.hour, r.channel) == ("2024-02-03", 5, "C13")


def test_sinks(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(2, day, 1.0), (1, day, 2.0)], "fid long, day date, v double")
    sinks.write_station_days(df, str(tmp_path / "a"))
    sinks.write_by_station(df, str(tmp_path / "b"))
    sinks.write_by_station(df.where("fid = 1").withColumn("v", F.lit(9.0)), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    assert {(r.fid, r.v) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {(2, 1.0), (1, 9.0)}
    sinks.write_artifact(spark, df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([(1, t(1, 3), 1.0), (1, t(1, 9), 3.0), (1, t(2, 1), 5.0), (1, t(5, 1), 7.0)], "fid long, ts timestamp, value double").coalesce(1).write.parquet(src)
    events = spark.readStream.schema("fid long, ts timestamp, value double").parquet(src)

    def end(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {(str(r.day), r["mean"], r.n) for r in end(streams.daily_stream(events), "daily")} == {("2024-01-01", 2.0, 2), ("2024-01-02", 5.0, 1)}
    assert {r.n for r in end(streams.run_stream(events), "runs")} == {3}
    assert all(r.n >= 2 for r in end(streams.sliding_stream(events, 2, 1, 2), "slides"))


def test_long_patch_is_one(spark):
    """Two arms of 130 cells that meet at the bottom, and a cell apart."""
    cells = [(r, c) for r in range(130) for c in (0, 2)] + [(129, 1), (0, 4)]
    df = spark.createDataFrame([(r, c, 1) for r, c in cells], "row int, col int, k int")
    got = {(r.row, r.col): r.patch for r in grid.patches(df, "k", 5).collect()}
    assert got == {x: 4 if x == (0, 4) else 0 for x in cells}


def test_spaced_follows_long_chains(spark):
    """A chain in hash order, whose points wait for each other over 52 rounds; a point alone."""
    ids = spark.range(105).select("id", stats.mixed_hash(F.col("id"), 3).alias("h")).orderBy("h", "id").collect()
    chain, alone = [r.id for r in ids[:-1]], ids[-1].id
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "src long, dst long")
    points = spark.createDataFrame([(i,) for i in [*chain, alone]], "fid long")
    assert sorted(r.fid for r in graph.spaced(points, edges, 3).collect()) == sorted([*chain[::2], alone])


def test_small_patches_merge_until_none_is_left(spark):
    """Two small patches, each the other's longest border, then a large one; one with no neighbour stays."""
    label = lambda r, c: 1 if c < 10 else 2 if c == 10 or r == 2 else 3
    cells = [(r, c, label(r, c)) for r in range(3) for c in range(12)] + [(9, 9, 4)]
    df = spark.createDataFrame(cells, "row int, col int, patch long")
    # 3 (two cells) joins 2, which then has six cells and joins 1
    got = {(r.row, r.col): r.patch for r in grid.merged_small(df, 8).collect()}
    assert got == {(r, c): 4 if r == 9 else 1 for r, c, _ in cells}
    assert {r.patch for r in grid.merged_small(df, 5).collect()} == {1, 2, 4}


def test_whole_tables_are_answered(spark):
    from helpers import DATA

    n = spark.read.parquet(f"{DATA}/customer.parquet").count()
    near = registry.QUERIES["j18_nearest_all"](spark, DATA).collect()
    assert len(near) == len({r.src for r in near}) == n
    assert any(r.fid % 2 for r in registry.QUERIES["j24_not_near_all"](spark, DATA).collect())
    cells = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert registry.QUERIES["g14_shelter_all"](spark, DATA).count() == 8 * cells
    years = registry.QUERIES["w11_repeated_years"](spark, DATA).collect()
    assert len({r.channel for r in years}) > 1 and len({r.year for r in years}) > 1
    assert any(0 < r.repeated < r.days for r in years)


def test_exact_quantiles(spark):
    """Against linear interpolation of the sorted values: a hot group, ties, one value, a null key, none."""
    rows = [("hot", float((i * 7919) % 10007)) for i in range(9000)] + [("tie", 2.0)] * 700 + [("tie", 5.0)] * 300
    rows += [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    values = {}
    for g, x in rows:
        if x is not None:
            values.setdefault(g, []).append(x)
    for edges in (32, 1):  # where the sketch cuts must not matter
        got = {r.g: (r.q, r.n) for r in quantiles(df, ["g"], "x", at, edges=edges).collect()}
        assert set(got) == set(values)
        for g, xs in values.items():
            assert got[g][1] == len(xs)
            assert got[g][0] == pytest.approx(np.quantile(xs, at).tolist())
    whole = quantiles(df, [], "x", at).collect()
    assert whole[0].q == pytest.approx(np.quantile(sum(values.values(), []), at).tolist())
    ranks = {r.g: r.q for r in quantiles(df, ["g"], "x", at, discrete=True).collect()}
    for g, xs in values.items():
        assert ranks[g] == [sorted(xs)[max(0, math.ceil(round(p * len(xs), 9)) - 1)] for p in at]
    assert quantiles(df.limit(0), [], "x", at).count() == 0


def test_strata_and_fill_without_global_sorts(spark):
    s = spark.range(400).select(F.col("id").alias("fid"), (F.col("id") % 100).cast("double").alias("elev"))
    kept = stats.strata_holdout(s, "elev", 0.15, 3)
    n = {r.stratum: r.n for r in kept.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 15, 1: 15, 2: 15, 3: 15}
    g = spark.createDataFrame([("a", 1.0), ("a", None), (None, 4.0), (None, None), ("b", None)], "k string, z double")
    got = sorted(grid.climatology_fill(g, ["k"], "z").collect(), key=str)
    assert Counter((r.k, r.z) for r in got) == Counter({("a", 1.0): 2, (None, 4.0): 2, ("b", None): 1})


def test_winsorised_keeps_rows_of_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, x double")
    assert [r.x for r in qc.winsorised(df, ["x"]).collect()] == [None, None]
    assert [r.x for r in qc.filled_by_train_median(df, ["x"], F.col("k") > 5).collect()] == [0.0, 0.0]


def test_probe_is_a_linear_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60)
    month = np.arange(60) % 3
    rows = [(int(m), [float(v) for v in a], float(b)) for m, a, b in zip(month, x, y, strict=True)]
    rows += [(5, [1.0, 2.0, 3.0], 1.0)] * 7 + [(6, [1.0, 2.0, 3.0], 2.0)] * 9 + [(0, None, 1.0), (0, [1.0], 1.0), (0, [1.0, None, 2.0], 1.0), (1, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "m int, v array<double>, y double").repartition(7)
    got = {r.m: (r.n, r.r2) for r in layers.probe(df, "m", "v", "y").collect()}
    assert set(got) == {0, 1, 2, 6} and got[6] == (9, None)
    for m in range(3):
        a = np.column_stack([np.ones(20), x[month == m]])
        rest = y[month == m] - a @ np.linalg.lstsq(a, y[month == m], rcond=None)[0]
        spread = y[month == m] - y[month == m].mean()
        assert got[m][0] == 20 and math.isclose(got[m][1], 1 - rest @ rest / (spread @ spread), abs_tol=1e-9)
    assert layers.probe(df.limit(0), "m", "v", "y").count() == 0


def test_cell_index_counts_heights_and_reaches_far(spark):
    place = "fid long, lat double, lon double, elev double"
    cells = spark.createDataFrame([(1, 45.0, -120.0, None), (2, 45.0, -120.0, 3000.0), (3, -45.0, 60.0, 0.0), (4, None, 1.0, 0.0)], place)
    stations = spark.createDataFrame([(7, 45.0, -119.9, 0.0), (8, 45.0, -119.8, 3000.0), (9, 45.2, -120.0, None)], place)
    flat = {(r.src, r["rank"]): r.dst for r in layers.cell_index(cells, stations, 2).collect()}
    assert flat == {(1, 1): 7, (1, 2): 8, (2, 1): 7, (2, 2): 8, (3, 1): flat[3, 1], (3, 2): flat[3, 2]}
    high = {(r.src, r["rank"]): r.dst for r in layers.cell_index(cells, stations, 1, 10.0).collect()}
    assert high[1, 1] == 7 and high[2, 1] == 8 and set(high) == {(1, 1), (2, 1), (3, 1)}
    few = layers.cell_index(cells, stations, 5)
    assert few.count() == 9 and layers.cell_index(cells.limit(0), stations, 5).count() == 0


def test_manifests_and_first_places(spark):
    df = spark.createDataFrame([("a:b:c",), ("plain",), (None,)], "key string")
    assert [r.fid for r in layers.keyed(df).collect()] == ["b:c", "plain", None]
    place = "fid string, lat double, lon double, elev double"
    a = spark.createDataFrame([("x", None, 2.0, 3.0)], place)
    c = spark.createDataFrame([("x", 5.0, 5.0, 5.0), ("y", 6.0, 6.0, None)], place)
    assert sorted(layers.discovered([a, c]).collect()) == [("x", None, 2.0, 3.0), ("y", 6.0, 6.0, None)]


def test_small_patches_go_by_direction_on_ties(spark):
    # patch 5 (class 2) has a border of two with 1 (class 6) and with 9 (class 3)
    rows = [(r, c, {0: 1, 1: 5, 2: 9}[c], {0: 6, 1: 2, 2: 3}[c], 4 if c == 1 else 1) for r in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "row int, col int, patch long, kind int, least int")
    assert {r.patch for r in grid.merged_small(df, "least", "kind").where("col = 1").collect()} == {9}
    assert {r.patch for r in grid.merged_small(df, "least").where("col = 1").collect()} == {1}
    assert {r.patch for r in grid.merged_small(df.drop("kind", "least"), 2).collect()} == {1, 5, 9}


def test_facets_of_a_ridge_at_two_scales(spark):
    rows = [(r, c, 100.0 - 10 * abs(c - 5)) for r in range(4, 16) for c in range(11)]
    df = spark.createDataFrame(rows, "row int, col int, z double")
    out = grid.facet_scales(df, "z", 10.0, [(5.0, 3), (20.0, 30)], 11).collect()
    assert {(r.scale, r.row, r.col) for r in out} == {(s, r, c) for s in (0, 1) for r, c, _ in rows}
    for s in (0, 1):
        side = {(r.kind, r.facet, r.col < 5) for r in out if r.scale == s and r.col != 5}
        assert {(k, west) for k, _, west in side} == {(7, True), (3, False)} and len({f for _, f, _ in side}) == 2
    ridge = {r.kind for r in out if r.scale == 0 and r.col == 5}
    assert ridge == {0}  # twelve flat cells, enough at the first scale
    assert 0 not in {r.kind for r in out if r.scale == 1}
    assert grid.facet_scales(df.limit(0), "z", 10.0, [(5.0, 3)], 11).count() == 0


def test_neighbours_by_day(spark):
    """Neighbours of a day are among that day's reports, whatever the density; as brute force finds them."""
    draw = random.Random(3)
    rows = []
    for day in range(4):
        for fid in range(120):
            if draw.random() < 0.5:
                dense = fid % 3 == 0  # a third of all stations within a few hundred metres
                lat, lon = (45 + fid * 1e-5, -120 + fid * 2e-5) if dense else (43 + fid % 11 * 0.31, -122 + fid % 13 * 0.37)
                rows.append((fid, dt.date(2024, 1, 1 + day), lat, lon))
    rows.append((500, None, 45.0, -120.0))
    df = spark.createDataFrame(rows, "fid long, day date, lat double, lon double")
    got, want = {}, {}
    for r in spatial.neighbours(df, df, 4, 150.0, keys=["day"]).collect():
        got.setdefault((r.day, r.src), []).append((r["rank"], round(r.km, 6)))
    for f, d, la, lo in rows[:-1]:
        near = sorted(_km(la, lo, x, y) for g, e, x, y in rows[:-1] if e == d and g != f)
        want[d, f] = [(i, round(km, 6)) for i, km in enumerate([km for km in near if km <= 150][:4], 1)]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_candidates_grow_with_the_points(spark):
    """The first radius follows the density."""
    def candidates(n):
        df = spark.range(n).selectExpr("id fid", "40 + (id * 7919 % 10007) / 10007.0d * 5 lat", "-120 + (id * 104729 % 20011) / 20011.0d * 5 lon")
        return spatial.within(df, df, spatial._start_km(df, 8, 150.0)).count()

    a, b = candidates(2000), candidates(4000)
    assert a < 2000 * 40 and b < 4000 * 40  # some 2 k for each point, whatever their number


def _km(la1, lo1, la2, lo2):
    p, q = math.radians(la1), math.radians(la2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_neighbours_end_when_no_point_lacks_any(spark, tmp_path):
    """The plan of a search whose points are all served early holds a scan a round, no joins and no reading of the sides."""
    spark.range(600).selectExpr("id fid", "42 + (id % 25) * 0.002d lat", "-120 + floor(id / 25) * 0.003d lon", "date_add(date '2024-01-01', int(id % 2)) day").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    at = {r.fid: r for r in df.collect()}
    for keys in ([], ["day"]):
        out = spatial.neighbours(df, df, 3, 150.0, keys=keys)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FileScan" not in plan
        got = {}
        for e in out.collect():
            got.setdefault(e.src, []).append((e["rank"], e.km))
        assert len(got) == len(at)
        for a in list(at.values())[::29]:
            near = sorted(_km(a.lat, a.lon, z.lat, z.lon) for z in at.values() if z.fid != a.fid and (not keys or z.day == a.day))
            assert [km for _, km in sorted(got[a.fid])] == pytest.approx(near[:3], abs=1e-6)


def test_pruned_edges_do_not_make_all_pairs(spark):
    """Rings around places, some of them shared and one beyond the date line, as brute force finds them; no join makes the pairs within the radius."""
    draw = random.Random(8)
    rows = [(i, 43 + draw.random() * 2, -121 + draw.random() * 2) for i in range(300)]
    rows += [(i + 300, *rows[i][1:]) for i in range(120)] + [(500, 60.0, 179.9), (501, 60.0, -179.6), (502, 60.3, -179.9), (503, None, 1.0), (504, 20.0, 20.0)]
    df = spark.createDataFrame(rows, "fid long, lat double, lon double").repartition(5)
    places = [r for r in rows if r[1] is not None]
    ring = {a[0]: sorted((round(_km(*a[1:], *z[1:]), 9), z[0]) for z in places if z[0] != a[0]) for a in places}
    got = {}
    for r in spatial.pruned(df, 20.0, 150.0, 4).collect():
        got.setdefault(r.dst, []).append((r["rank"], round(r.km, 3), r.src))
    want = {a: [(i, round(km, 3), f) for i, (km, f) in enumerate([x for x in near if 20 <= x[0] <= 150][:4], 1)] for a, near in ring.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    mixed = {}
    for r in spatial.pruned_mixed(df, 40.0, 150.0, 3, 8).collect():
        mixed.setdefault(r.dst, []).append((round(r.km, 3), r.src))
    for a, near in ring.items():
        local = [x for x in near if x[0] <= 40][:3]
        far = [x for x in near if 40 < x[0] <= 150][: 8 - len(local)]
        assert sorted(mixed.get(a, [])) == [(round(km, 3), f) for km, f in local + far]


@pytest.mark.parametrize("name", ["j23_pruned", "j23_mixed_local"])
def test_pruning_joins_few_rows(spark, tmp_path, name):
    """No join of the whole run makes more than forty rows a station, where all pairs within 150 km are above a hundred."""
    folder = _stations_at(spark, tmp_path, 3000)
    assert max(_joined_rows(spark, lambda: registry.QUERIES[name](spark, folder).collect())) < 3000 * 40


def _joined_rows(spark, run):
    """Rows that each join of a run's executions gave, rounds among them."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    runs = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    first = max(runs(), default=-1) + 1
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for one in (i for i in runs() if i >= first):
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name():
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return rows


def _stations_at(spark, folder, n):
    spark.range(n).selectExpr("id c_custkey", "'x' c_name", "1 c_nationkey", "1.0d c_acctbal", "'s' c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_similar_neighbours_by_blocks(spark, monkeypatch):
    """Most and least alike of all within the radius, ties by id, with tiles dealt to several tasks and small batches, as brute force finds them."""
    monkeypatch.setattr(spatial, "HELD", 40)
    for name, value in (("OWN", 16), ("OTHER", 32), ("PAIRS", 50)):
        monkeypatch.setattr(spatial._Alike, name, value)
    draw = random.Random(2)
    rows = [(i, 43 + draw.random() * 3, -121 + draw.random() * 3, [float(draw.randint(0, 2)) for _ in range(4)]) for i in range(400)]
    rows += [(900, 80.0, 10.0, [1.0] * 4), (901, 80.1, 10.0, [2.0] * 4), (902, None, 1.0, [0.0] * 4), (903, 1.0, 1.0, [0.0] * 4)]
    rows += [(5, *rows[5][1:3], [1.0] * 4), (901, 80.1, 10.0, [2.0] * 4)]  # ids of two rows
    df = spark.createDataFrame(rows, "fid long, lat double, lon double, vec array<double>").repartition(3)
    got = Counter((r.src, r.dst, round(r.km, 4)) for r in spatial.similar_neighbours(df, 60.0, 10).collect())
    places, want = [r for r in rows if r[1] is not None], Counter()
    for src in {r[0] for r in places}:
        near = [(sum((p - q) ** 2 for p, q in zip(a[3], z[3], strict=True)), z[0], round(km, 4)) for a in places if a[0] == src for z in places if z[0] != src and (km := _km(a[1], a[2], z[1], z[2])) <= 60]
        want.update((src, f, km) for i, (_, f, km) in enumerate(sorted(near)) if i < 7 or i >= len(near) - 3)
    assert got == want


def test_similar_neighbours_join_few_rows(spark, tmp_path):
    """No join makes the pairs within 120 km."""
    folder = _stations_at(spark, tmp_path, 3000)
    spark.range(3000).selectExpr("id vec_id", "transform(sequence(1, 8), i -> float(id * i % 13)) embedding", "1 label").write.parquet(f"{folder}/embeddings.parquet")
    assert max(_joined_rows(spark, lambda: registry.QUERIES["j14_similar_neighbours"](spark, folder).collect())) < 3000 * 40


@pytest.mark.parametrize("scale", [None, 10.0])
def test_cells_meet_few_nodes(spark, monkeypatch, scale):
    """Cells all over the globe, many of them far, against stations in several nodes, as brute force finds them; no join makes the pairs and rows stay few."""
    for name, value in (("LEAST", 16), ("DEALT", 50)):
        monkeypatch.setattr(spatial, name, value, raising=False)
    draw = random.Random(6)
    stations = [(i, 42 + draw.random() * 7, -125 + draw.random() * 21, float(draw.randint(0, 3000))) for i in range(400)]
    stations += [(i + 400, *stations[i][1:]) for i in range(90)] + [(600, 44.0, 179.95, 5.0), (601, 44.1, -179.95, 5.0), (602, None, 1.0, 5.0)]
    cells = [(i, 42 + i * 0.9, -125 + i % 50 * 0.4, float(draw.randint(900, 2000))) for i in range(500)]
    place = "fid long, lat double, lon double, elev double"
    a, z = spark.createDataFrame(cells, place).repartition(3), spark.createDataFrame(stations, place).repartition(3)
    got = {}
    made = _joined_rows(spark, lambda: got.update({(r.src, r["rank"]): (r.dst, r.km) for r in layers.cell_index(a, z, 4, scale).collect()}))
    assert max(made) < 500 * 12
    places = [s for s in stations if s[1] is not None]
    for i, la, lo, h in cells:
        near = sorted((math.hypot(km := _km(la, lo, x, y), (scale or 0) * (e - h) / 1000), f, km) for f, x, y, e in places)[:4]
        assert [got[i, n][1] for n in range(1, 5)] == pytest.approx([km for _, _, km in near], abs=1e-4)
        assert all(got[i, n][0] == near[n - 1][1] for n in range(1, 5) if near[n - 1][2] < 19000)
    assert len(got) == 2000


@pytest.mark.parametrize("name", ["j16_cell_stations", "j26_station_grid_edges"])
def test_cells_of_a_whole_run_meet_few_nodes(spark, name):
    """No join of the whole run makes more rows than the result, or a dozen a cell."""
    from helpers import DATA

    found, cells = [], spark.read.parquet(f"{DATA}/part.parquet").count()
    made = _joined_rows(spark, lambda: found.extend(__spark_entry__.queries()[name](spark, DATA).collect()))
    assert max(made) <= max(len(found), 12 * cells)
