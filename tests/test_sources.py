"""Numbered lines over many blocks, buoy text, bucketed tables, node tables and filled stars."""

import datetime as dt
import random

import pytest

from isohyet.operators import graph, layers
from isohyet.sources import sinks, text


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_lines_are_numbered_across_blocks(spark, tmp_path, block):
    draw = random.Random(block)
    files = {f"f{i}.txt": ["x" * draw.randint(0, 60) + str(n) for n in range(draw.randint(1, 80))] for i in range(4)} | {"empty.txt": []}
    for name, rows in files.items():
        (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [(r.file.rsplit("/", 1)[1], r["at"], r.value) for r in text.lines(spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted((name, i, v) for name, rows in files.items() for i, v in enumerate(rows))
        ids = text.fixed_ids(spark, str(tmp_path), 3, 0, 5)
        assert {r.fid for r in ids.collect()} == {v[:5].strip() for rows in files.values() for v in rows[3:]}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_buoy_headers_and_sentinels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#YY MM DD hh mm WSPD WDIR\n#yr mo dy hr mn m/s deg\n2024 01 02 03 04 5.5 99\n2024 01 02 03 04 6.5 10\n2024 13 02 03 04 1 1\n")
    (tmp_path / "b.txt").write_text("YY MM DD hh WDIR WSPD\n98 01 02 03 999 99.0\n\n98 01 02 04 MM 3\n")
    (tmp_path / "c.txt").write_text("2023 05 06 07 08 200 4 5 1 2 3 180 1013 20 21 9 10 1\n")

    def rows(**kind):
        return {(str(r.ts), r.wdir, r.wind, r.pressure) for r in text.buoy(spark, str(tmp_path), **kind).collect()}

    want = {("1998-01-02 03:00:00", None, None, None), ("1998-01-02 04:00:00", None, 3.0, None), ("2023-05-06 07:08:00", 200.0, 4.0, 1013.0)}
    assert rows() == want | {("2024-01-02 03:04:00", None, 5.5, None)}
    assert rows(legacy=False) == want | {("2024-01-02 03:04:00", 99.0, 5.5, None)}


def test_drifting_csv(spark, tmp_path):
    (tmp_path / "x_2001.csv").write_text("system:index,id,.geo,B1\na,1,{},2.5\n,,,\n")
    (tmp_path / "x_2002.csv").write_text("id,B2\n2,7\n")
    out = text.drifting_csv(spark, [str(tmp_path / "x_2001.csv"), str(tmp_path / "x_2002.csv")])
    assert {(r.id, r.B1, r.B2, r.year) for r in out.collect()} == {(1, 2.5, None, 2001), (2, None, 7, 2002)}


def test_bucketed_joins_need_no_exchange(spark, tmp_path):
    days = spark.range(4000).selectExpr("id % 50 fid", "date_add(date'2024-01-01', int(id div 50)) day", "double(id) v")
    a = sinks.write_bucketed(days, "t_days", str(tmp_path / "d"), 4, ["fid"], ["day"])
    b = sinks.write_bucketed(days.select("fid").distinct(), "t_places", str(tmp_path / "p"), 4, ["fid"])
    out = a.join(b.hint("merge"), "fid").groupBy("fid").agg({"v": "sum"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert out.count() == 50
    again = sinks.write_bucketed(days.where("fid < 10"), "t_days", str(tmp_path / "d"), 4, ["fid"], ["day"])
    assert again.count() == 800


def test_node_table_masks(spark):
    """Held-out stations keep their node and lend their target to nobody; what is not finite is 0."""
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([("A", day, 1.0, 2.0), ("B", day, float("nan"), 6.0), ("C", day, None, float("inf")), ("D", day, 3.0, -50.0)], "fid string, day date, w double, y double")
    places = spark.createDataFrame([(f, 45.0, -120.0, 5.0) for f in "ABC"], "fid string, lat double, lon double, elev double")
    edges = spark.createDataFrame([(a, z) for a in "ABCD" for z in "ABCD" if a != z], "src string, dst string")
    held = spark.createDataFrame([("B",)], "fid string")
    out = {r.fid: r for r in graph.node_table(rows, places, edges, held, ["w", "none"], ["elev"], ["y"], 40.0).collect()}
    assert set(out) == set("ABCD")
    assert out["A"].x[:6] == [1.0, 0.0, 5.0, -50.0, 0.0, 1.0]  # of D alone: B is held out, C not finite
    assert out["B"].x[:6] == [0.0, 0.0, 5.0, -24.0, 26.0, 2.0] and (out["B"].y, out["B"].supervised) == ([6.0], [True])
    assert (out["C"].y, out["C"].supervised) == ([0.0], [False]) == (out["D"].y, out["D"].supervised)
    assert out["D"].x[2] == 0 and out["D"].x[-2:] == [0.0, 0.0] and all(len(r.x) == 10 for r in out.values())
    assert graph.node_table(rows.limit(0), places, edges, held, ["w"], ["elev"], ["y"]).count() == 0


def test_filled_stars(spark):
    edges = spark.createDataFrame([("A", "B", 1, 3.0, 0.1), ("A", "C", 2, 4.0, 0.2), ("A", "D", 3, 5.0, 0.3), ("B", "A", 1, 3.0, 0.4)], "src string, dst string, rank int, km double, bearing double")
    stations = spark.createDataFrame([(f,) for f in "ABCDE"], "fid string")
    records = spark.createDataFrame([("A", 9), ("D", 9), ("B", 7), ("C", 1)], "fid string, days int")
    stars = layers.filled_stars(edges, stations, records, 2, 3)
    got = {(r.fid, r.place): (r.dst, r.filler, r.km) for r in stars.collect()}
    assert got == {
        ("A", 1): ("B", False, 3.0), ("A", 2): ("C", False, 4.0), ("B", 1): ("A", False, 3.0), ("B", 2): ("D", True, 0.0),
        ("C", 1): ("A", True, 0.0), ("C", 2): ("D", True, 0.0), ("D", 1): ("A", True, 0.0), ("D", 2): ("B", True, 0.0),
        ("E", 1): ("A", True, 0.0), ("E", 2): ("D", True, 0.0),
    }
    day = lambda n: dt.date(2024, 1, n)
    obs = spark.createDataFrame([("A", day(i), float(i), 10.0 * i) for i in (1, 2, 3, 5)] + [("E", day(3), 7.0, 1.0), ("E", day(5), 7.0, 1.0)], "fid string, day date, v double, o double")
    out = layers.star_samples(obs.where("fid = 'E'"), stars, obs, "v", ["o"], 3).where("dst = 'A'").collect()
    by = {r.day.day: r for r in out}
    assert (by[3].known, by[3].today, by[3].lagged, by[3].o_seq, by[3].o_delta) == (True, 3.0, [1.0, 1.0, 2.0], [10.0, 20.0, 30.0], -29.0)
    assert (by[5].known, by[5].today, by[5].lagged, by[5].o_delta) == (False, 0.0, [0.0] * 3, 1.0)


def test_grid_source_prunes_days(spark, tmp_path):
    from pyspark.sql import functions as F

    from isohyet.sources import grids

    path = f"file://{tmp_path}/grid"
    rows = spark.range(40).selectExpr("date_add(date'2024-01-01', int(id div 4)) day", "int(id % 2) row", "int(id % 4 div 2) col", "double(id) TMP", "float(id) U")
    rows.write.partitionBy("day").parquet(path)
    spark.dataSource.register(grids.GridSource)
    read = lambda **more: spark.read.format("daily_grid").options(path=path, product="net", columns="TMP=tmp,U=u", **more).load()
    assert read().columns == ["day", "row", "col", "tmp_net", "u_net"] and read().count() == 40
    assert read(first="2024-01-03", last="2024-01-04").count() == 8 and read(first="2025-01-01").count() == 0
    assert grids.available_range(read()) == (dt.date(2024, 1, 1), dt.date(2024, 1, 10))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = read(pushdown="true").where((F.col("day") > F.lit(dt.date(2024, 1, 7))) & (F.col("day") <= F.lit(dt.date(2024, 1, 9))) & (F.col("tmp_net") > 28))
        assert few.rdd.getNumPartitions() == 2
        assert {(str(r.day), r.tmp_net) for r in few.collect()} == {("2024-01-08", float(i)) for i in (29, 30, 31)} | {("2024-01-09", float(i)) for i in (32, 33, 34, 35)}
        assert read(pushdown="true").where(F.col("day") == F.lit(dt.date(2030, 1, 1))).count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_day_layer_builds_changed_days_alone(spark, tmp_path):
    import os

    from isohyet.sources import grids

    make = lambda rows: spark.createDataFrame([(dt.date(2024, 1, d), 0, c, x) for d, c, x in rows], "day date, row int, col int, v double")
    layer = grids.DayLayer(spark, str(tmp_path / "l"), ["v"])
    a, b = make([(1, 0, 1.0), (2, 0, None)]), make([(1, 0, 9.0), (1, 1, 8.0), (2, 0, 7.0), (3, 0, 6.0)])
    assert layer.build([a, b]).count() == 3
    got = lambda: sorted((r.day.day, r.col, r.v) for r in layer.read().collect())
    assert got() == [(1, 0, 1.0), (1, 1, 8.0), (2, 0, 7.0), (3, 0, 6.0)]
    stamp = {d: os.stat(f"{layer.path}/layer/{d}").st_mtime_ns for d in os.listdir(f"{layer.path}/layer") if d.startswith("day")}
    assert [r.day.day for r in layer.build([make([(1, 0, 1.0), (2, 0, 5.0)]), b]).collect()] == [2]
    assert got() == [(1, 0, 1.0), (1, 1, 8.0), (2, 0, 5.0), (3, 0, 6.0)]
    after = {d: os.stat(f"{layer.path}/layer/{d}").st_mtime_ns for d in stamp}
    assert {d for d in stamp if after[d] != stamp[d]} == {"day=2024-01-02"}
    assert layer.build([make([(1, 0, 1.0), (2, 0, 5.0)]), b]).count() == 0
    layer.build([make([(1, 0, 1.0), (2, 0, 5.0)]), b.where("day < '2024-01-03'")])
    assert got() == [(1, 0, 1.0), (1, 1, 8.0), (2, 0, 5.0)]  # a day that no source has any more is not read


def test_water_years(spark):
    columns = "fid string, wy int, d int, " + ", ".join(f"{m} double" for m in text.MONTHS)
    none = dict.fromkeys(text.MONTHS)
    row = lambda f, wy, d, **x: (f, wy, d, *(none | x).values())
    df = spark.createDataFrame([row("a", 2000, 1, Oct=1.0, Nov=3.0, Sep=9.0), row("a", 2001, 1, Oct=2.0), row("a", 2000, 30, Feb=5.0, Jan=4.0), row("a", 2000, 29, Feb=4.5)], columns)
    days = lambda **k: {str(r.day): r.v for r in text.water_years(df, "fid", "v", **k).collect()}
    assert days() == {"1999-10-01": 1.0, "1999-11-01": 3.0, "2000-09-01": 9.0, "2000-10-01": 2.0, "2000-01-30": 4.0, "2000-02-29": 4.5}
    assert days(cumulative=True) == {"1999-10-01": 1.0, "1999-11-01": 2.0, "2000-01-30": 1.0, "2000-02-29": 0.5, "2000-09-01": 4.5, "2000-10-01": 2.0}
    assert days(cumulative=True, reset=False)["2000-10-01"] == -7.0 and days(cumulative=True, reset=False)["1999-10-01"] is None
    assert days(unit="fahrenheit")["2000-10-01"] == (2 - 32) * 5 / 9 and days(unit="inch")["2000-10-01"] == 50.8


def test_station_attributes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fid,Y,X,slope,o\ns1,45,-120,1.5,q\ns2,x,-121,,q\n,1,1,1,1\n")
    (tmp_path / "b.csv").write_text("fid,Y,X,slope,o\ns1,46,-120,9,q\ns3,47,-122,3,q\n")
    out = text.station_attributes(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "fid", ["slope"], ("Y", "X"))
    assert {tuple(r) for r in out.collect()} == {("s1", 45.0, -120.0, 1.5), ("s2", None, -121.0, None), ("s3", 47.0, -122.0, 3.0)}


@pytest.mark.parametrize("tasks", [1, 7])
def test_byte_ranges_across_tasks(spark, tmp_path, tasks):
    """Ranges of messages in any order, in more than one file; no window holds a file."""
    draw, want = random.Random(tasks), set()
    for name in "ab":
        first = sorted(draw.sample(range(10_000), 200))
        rows = [f"{i}:{x}:d=2024010100:TMP:2 m above ground:anl:" for i, x in enumerate(first)]
        want |= {(name, i, x, z - 1) for i, (x, z) in enumerate(zip(first, first[1:] + [0], strict=True))}
        draw.shuffle(rows)
        (tmp_path / f"{name}.idx").write_text("\n".join(rows))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = text.byte_ranges(spark, str(tmp_path))
        assert {(r.file[-5], r.msg, r["first"], r["last"]) for r in out.collect()} == want and out.count() == 400
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert any("windowspecdefinition(file" in x and "_part" in x and "msg" in x for x in plan.splitlines())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_one_file_of_rows_in_order(spark, tmp_path):
    """The file's lines are in order, from rows of several ranges; no rows make an empty file."""
    from isohyet.plans import queries_sources

    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS at", "cast((id * 7919) % 5000 AS string) AS value")
    path = queries_sources.as_file(rows.repartition(5), str(tmp_path), "rows.txt")
    assert open(path).read().split() == [str(i) for i in range(5000)]
    empty = queries_sources.as_file(rows.where("at < 0"), str(tmp_path), "empty.txt")
    assert open(empty).read() == ""


def test_by_station_keeps_its_tasks(spark, tmp_path):
    """Stations are dealt to all tasks, however few bytes there are: with 50 stations each task gets some."""
    rows = spark.range(50).selectExpr("id AS fid", "1.0d AS v")
    sinks.write_by_station(rows, str(tmp_path / "s"))
    files = [str(p) for p in (tmp_path / "s").rglob("part-*.parquet")]
    assert len(files) == 50
    assert len({p.rsplit("part-", 1)[1].split("-")[0] for p in files}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_by_station_files_are_made_without_processes(spark, tmp_path):
    """A second write replaces its stations' folders whole and leaves the others; no checksum beside a file, as Hadoop's writer, which starts processes, makes it."""
    at = tmp_path / "s"
    rows = spark.range(60).selectExpr("if(id < 50, id % 20, null) AS fid", "date_add(date '2024-01-01', int(id)) AS day", "if(id % 3 = 0, null, id / 2) AS v")
    sinks.write_by_station(rows, f"file://{at}")
    sinks.write_by_station(rows.where("fid % 4 = 0 and v > 3").selectExpr("fid", "day", "-v AS v"), f"file://{at}")
    want = rows.where("fid is null or fid % 4 > 0").unionByName(rows.where("fid % 4 = 0 and v > 3").selectExpr("fid", "day", "-v AS v"))
    back = spark.read.schema("day date, v double, fid long").parquet(str(at))
    line = lambda df: sorted(map(str, df.select("fid", "day", "v").collect()))
    assert line(back) == line(want)
    assert len(list(at.rglob("*.parquet"))) == len([p for p in at.iterdir() if p.is_dir()]) == 21
    assert (at / "_SUCCESS").exists() and not list(at.rglob("*.parquet.crc")) and not list(at.glob(".staging*"))
