"""Upserts by partition and the rejection stream."""

import datetime as dt
import os
import random

import pytest

from isohyet.streaming import streams, upserts

SCHEMA = "fid long, day date, x string, at int"


def day(n):
    return dt.date(2024, 1, n)


def rows_of(df):
    return sorted(((r.fid, r.day, r.x) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return upserts.UpsertTable(spark, str(tmp_path / "up"), ["fid", "day"], ["at"], "day")


def files(path):
    return {f"{top}/{n}": os.stat(f"{top}/{n}").st_mtime_ns for top, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_rewrites_touched_partitions_alone(spark, table):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    table.merge(make([(f, day(d), "old", 0) for f in (1, 2) for d in range(1, 9)]), 0)
    before = files(table.path + "/data")
    table.merge(make([(2, day(3), "stale", 1), (2, day(3), "new", 3), (2, day(3), "late", 2), (9, day(3), "first", 1)]), 1)
    after = files(table.path + "/data")
    assert {k: after[k] for k in before} == before
    made = after.keys() - before.keys()
    assert made and all("/batch=1/_part=p2024-01-03/" in f for f in made)
    want = [(f, day(d), "new" if (f, d) == (2, 3) else "old") for f in (1, 2) for d in range(1, 9)] + [(9, day(3), "first")]
    assert rows_of(table.read()) == sorted(want, key=str)
    assert table.read().columns == ["fid", "day", "x", "at"]


def test_upsert_repeated_and_lost_batches(spark, table):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    a, b = make([(1, day(1), "a", 0), (1, None, "n", 0), (None, day(2), "m", 0)]), make([(1, day(1), "b", 0), (1, None, "k", 0), (None, day(2), "o", 1)])
    table.merge(a, 0)
    table.merge(b, 1)
    want = rows_of(table.read())
    assert want == sorted([(1, day(1), "b"), (1, None, "k"), (None, day(2), "o")], key=str)
    table.merge(b, 1)
    assert rows_of(table.read()) == want
    with pytest.raises(ValueError, match="predecessor"):
        table.merge(a, 3)
    assert rows_of(table.read()) == want and table.commits() == [0, 1]
    table.merge(make([]), 2)
    assert rows_of(table.read()) == want
    os.remove(f"{table.path}/commits/000000002/_SUCCESS")  # a commit that broke off is not seen
    assert table.commits() == [0, 1] and rows_of(table.read()) == want


def test_upsert_sweep(spark, table):
    make = lambda d, x: spark.createDataFrame([(1, day(d), x, 0)], SCHEMA)
    for number, (d, x) in enumerate([(1, "a"), (2, "b"), (1, "c"), (1, "d"), (1, "e")]):
        table.merge(make(d, x), number)
    assert table.sweep() == 2  # day 1 of batches 0 and 2; batch 3 may be needed again
    assert rows_of(table.read()) == sorted([(1, day(1), "e"), (1, day(2), "b")], key=str) and table.commits() == [3, 4]
    table.merge(make(1, "f"), 4)
    assert rows_of(table.read()) == sorted([(1, day(1), "f"), (1, day(2), "b")], key=str)


def test_upsert_empty_and_wrong_partition(spark, table):
    table.merge(spark.createDataFrame([], SCHEMA), 0)
    assert table.read().count() == 0
    with pytest.raises(ValueError, match="keys"):
        upserts.UpsertTable(spark, table.path, ["fid"], ["at"], "day")


def monitored(rows, days, limit):
    held = {}
    for fid, d, n, bad in rows:
        a, b = held.get((fid, d), (0, 0))
        held[fid, d] = a + n, b + bad
    out = set()
    for (fid, d), (n, bad) in held.items():
        near = [v for (f, x), v in held.items() if f == fid and d - dt.timedelta(days=days) < x <= d]
        total = sum(v[0] for v in near)
        rate = sum(v[1] for v in near) / total if total else None
        out.add((fid, d, n, bad, None if rate is None else round(rate, 9), None if rate is None else rate > limit))
    return out


def test_rejection_stream_out_of_order(spark, tmp_path):
    draw = random.Random(7)
    start = dt.date(2024, 1, 1)
    rows = [(draw.randint(1, 5), start + dt.timedelta(days=draw.randint(0, 40)), draw.randint(0, 3), 0) for _ in range(300)]
    rows = [(f, d, n, draw.randint(0, n)) for f, d, n, _ in rows]
    rows.sort(key=lambda r: (r[1] - start).days + draw.randint(0, 5))
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[(-1, start + dt.timedelta(days=200), 0, 0)], [(3, start, 5, 5)]]
    schema = "fid long, day date, n long, bad long"
    for b in batches:  # the last one is of a day long closed
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.rejection_stream(source, 10, 0.5)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query = run.trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.fid, r.day, r.n, r.bad, None if r.rate is None else round(r.rate, 9), r.listed) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == monitored(rows, 10, 0.5)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 5 and kept[-1] <= 1  # what no open day can reach has left the state


def test_rejection_stream_calls_by_shard(spark, tmp_path):
    """Python is called for a shard of stations, not for each station; a station may be null, a count too."""
    start = dt.date(2024, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(4)]
    rows = [(f, d, 2, f % 3) for f in range(2**60, 2**60 + 40) for d in days] + [(None, days[1], 4, 1), (0, days[1], 3, None)]
    schema = "fid long, day date, n long, bad long"
    for b in (rows, [(-1, start + dt.timedelta(days=30), 0, 0)]):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.rejection_stream(source, 2, 0.5, shards=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.fid, r.day): (r.n, r.bad, r.rate, r.listed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(f, d): (2, f % 3, f % 3 / 2, f % 3 == 2) for f in range(2**60, 2**60 + 40) for d in days}
    assert got == want | {(None, days[1]): (4, 1, 0.25, False), (0, days[1]): (3, 0, 0.0, False)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
