"""Halo tiles against brute force, with tiles smaller than the grids."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import isohyet.plans.queries_io  # noqa: F401
from isohyet.operators import grid, halo
from isohyet.plans import registry


def cells_of(spark, seed, height=13, width=17, missing=0.15, keys=("x",)):
    draw = random.Random(seed)
    rows = []
    for key in keys:
        for r in range(-3, height - 3):
            for c in range(-2, width - 2):
                if draw.random() > missing:
                    rows.append((key, r, c, None if draw.random() < 0.1 else float(draw.randint(0, 9)), draw.randint(0, 2), "own"))
    return rows, spark.createDataFrame(rows, "key string, row int, col int, z double, k int, _made string")


def brute_focal(rows, kernel, how, cover):
    out = {}
    at = {(k, r, c): z for k, r, c, z, _, _ in rows if z is not None}
    for k, r, c, *_ in rows:
        near = [(w, at[k, r + a, c + b]) for a, b, w in kernel if (k, r + a, c + b) in at]
        weight = sum(w for w, _ in near)
        if how == "min":
            out[k, r, c] = min((x for _, x in near), default=None)
        else:
            enough = weight and weight >= cover * sum(w for _, _, w in kernel)
            out[k, r, c] = sum(w * x for w, x in near) / weight if enough else None
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k, x in a.items():
        assert (x is None) == (b[k] is None) and (x is None or abs(x - b[k]) < 1e-9), (k, x, b[k])


@pytest.mark.parametrize("size,reach", [(4, 2), (5, 7), (256, 3)])
@pytest.mark.parametrize("how,cover", [("mean", 0.0), ("mean", 0.8), ("min", 0.0)])
def test_focal(spark, size, reach, how, cover):
    rows, df = cells_of(spark, size, keys=("x", None, "y"))
    kernel = grid.disc(reach, lambda d2: math.exp(-d2 / 5))
    out = halo.focal(df, kernel, "z", how, cover, ["key"], size).collect()
    assert {c for c in out[0].asDict()} == {"key", "row", "col", "z", "k", "_made", "z_focal"} and all(r["_made"] == "own" for r in out)
    same({(r.key, r.row, r.col): r.z_focal for r in out}, brute_focal(rows, kernel, how, cover))


def test_repeated_and_odd_cells(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, None), (None, 1, 5.0), (1, None, 5.0), (-1, 1, float("nan"))], "row int, col int, z double")
    out = Counter((r.row, r.col, r.z_focal) for r in halo.focal(df, grid.box(1), "z", size=2).collect())
    assert out == Counter({(0, 0, 2.0): 2, (0, 1, 2.0): 1, (None, 1, None): 1, (1, None, None): 1, (-1, 1, 2.0): 1})
    assert halo.focal(df.limit(0), grid.box(1), "z").count() == 0
    assert halo.patches(df.limit(0), "z", 9).count() == 0 and halo.borders(df.limit(0).selectExpr("row", "col", "1L patch")).count() == 0


@pytest.mark.parametrize("size", [3, 8, 256])
def test_position_index(spark, size):
    rows, df = cells_of(spark, 3)
    mean = brute_focal(rows, grid.box(4), "mean", 0.0)
    want = {(k, r, c): None if z is None else z - mean[k, r, c] for k, r, c, z, _, _ in rows}
    same({(r.key, r.row, r.col): r.tpi for r in halo.position_index(df, "z", 4, size=size).collect()}, want)


@pytest.mark.parametrize("size", [4, 256])
def test_seam_gap(spark, size):
    rows, df = cells_of(spark, 4)
    label = {(r, c): k for _, r, c, _, k, _ in rows}
    want = {}
    for (r, c), k in label.items():
        near = [math.hypot(a, b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9 and label.get((r + a, c + b), k) != k]
        want[r, c] = min(near, default=None)
    same({(r.row, r.col): r.gap for r in halo.seam_gap(df, "k", 3, size=size).collect()}, want)


def brute_patches(label, width, diagonal):
    out = {}
    for start in sorted(label):
        if start in out:
            continue
        found, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    n = r + a, c + b
                    if (diagonal or not (a and b)) and n not in found and label.get(n) == label[start]:
                        found.add(n)
                        todo.append(n)
        least = min(r * width + c for r, c in found)
        out |= dict.fromkeys(found, least)
    return out


@pytest.mark.parametrize("size", [1, 3, 5, 256])
@pytest.mark.parametrize("diagonal", [True, False])
def test_patches_and_borders(spark, size, diagonal):
    rows, df = cells_of(spark, 10 + size)
    df = df.where("row >= 0 and col >= 0")
    label = {(r, c): k for _, r, c, _, k, _ in rows if r >= 0 and c >= 0}
    want = brute_patches(label, 20, diagonal)
    out = halo.patches(df, "k", 20, diagonal, size).checkpoint()
    assert {(r.row, r.col): r.patch for r in out.collect()} == want
    pairs = Counter((want[x], want[r + a, c + b]) for x in want for r, c in [x] for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (r + a, c + b) in want and want[x] != want[r + a, c + b])
    assert {(r.a, r.b): r.n for r in halo.borders(out, size=size).collect()} == pairs


def test_long_patches(spark):
    """A spiral through many tiles is one patch."""
    n = 24
    path, r, c, dr, dc = set(), 0, 0, 0, 1
    blocked = set()
    for _ in range(n * n):
        path.add((r, c))
        a, b = r + dr, c + dc
        ahead = (a + dr, b + dc)
        if not (0 <= a < n and 0 <= b < n) or ahead in path or (a, b) in path:
            dr, dc = dc, -dr
            a, b = r + dr, c + dc
            if not (0 <= a < n and 0 <= b < n) or (a + dr, b + dc) in path or (a, b) in path:
                break
        r, c = a, b
    blocked = {(i, j) for i in range(n) for j in range(n)} - path
    rows = [(i, j, 1) for i, j in path] + [(i, j, 0) for i, j in blocked]
    df = spark.createDataFrame(rows, "row int, col int, k int")
    out = {(x.row, x.col): x.patch for x in halo.patches(df, "k", n, False, 5).collect()}
    assert out == brute_patches({(i, j): k for i, j, k in rows}, n, False) and len(path) > 200


def test_shuffle_is_halo_sized(spark):
    """A kernel of radius 20 sends each cell to the tiles that see it, not to each of its 1,257 places."""
    df = spark.range(512 * 512).selectExpr("int(id div 512) row", "int(id % 512) col", "double(id % 97) z")
    out = halo.focal(df, grid.disc(20), "z")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    dealt = df.selectExpr("explode(sequence(floor((row - 20) / 256), floor((row + 20) / 256))) a", "col")
    dealt = dealt.selectExpr("explode(sequence(floor((col - 20) / 256), floor((col + 20) / 256))) b")
    assert dealt.count() <= 1.4 * df.count()


@pytest.mark.parametrize("size", [4, 256])
def test_shelter(spark, size):
    rows, df = cells_of(spark, 21, missing=0.05)
    at = {(r, c): z for _, r, c, z, _, _ in rows if z is not None}
    azimuths, distances = [0.0, 45.0, 200.0], [2000.0, 4000.0]
    out = {(r.row, r.col): r for r in halo.shelter(df.select("row", "col", "z"), "z", 1000.0, azimuths, distances, 10.0, 3, size=size).collect()}
    assert len(out) == len(rows)
    for (r, c), got in out.items():
        for a in azimuths:
            for d in distances:
                seen = []
                for angle in (a - 10, a, a + 10):
                    for k in range(1, int(d / 1000) + 1):
                        n = r + round(-math.cos(math.radians(angle)) * k), c + round(math.sin(math.radians(angle)) * k)
                        if n in at and (r, c) in at:
                            seen.append((at[n] - at[r, c]) / (k * 1000))
                want = None if (r, c) not in at else max(seen, default=0.0)
                value = got[f"sx_{int(a):03d}_{int(d // 1000)}k"]
                assert value == want or abs(value - want) < 1e-12


@pytest.mark.parametrize("size", [4, 256])
def test_rays(spark, size):
    """As brute force over all rows of cells, some repeated, some without a value; no join, whatever the grid."""
    rows, df = cells_of(spark, 11)
    df = df.unionByName(spark.createDataFrame(rows[:9], df.schema).withColumn("z", F.col("z") + 2))
    rows = [(r.row, r.col, r.z) for r in df.collect()]
    out = halo.rays(df, "z", 10.0, 4, size)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    at = {}
    for r, c, z in rows:
        at.setdefault((r, c), []).append(z)
    got = {(r.row, r.col, r.ray): r.sx for r in out.collect()}
    assert len(got) == out.count() == 8 * len(at)
    for (r, c), own in at.items():
        for i, (a, b) in enumerate(halo.RAYS):
            seen = [(x - z) / (s * 10.0 * math.sqrt(abs(a) + abs(b))) for z in own if z is not None for s in range(1, 5) for x in at.get((r + s * a, c + s * b), []) if x is not None]
            assert got[r, c, i] == pytest.approx(max([0.0, *seen]))


def test_shelter_of_every_cell_makes_no_join(spark):
    from helpers import DATA

    plan = registry.QUERIES["g14_shelter_all"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
