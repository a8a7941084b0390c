"""Kernels, seams, labels and borders of rasters by tiles with a halo.

Cells are dealt to square tiles.  A cell also goes to the neighbouring tiles that can
see it, so a tile of side s and a kernel of reach r shuffles (1 + 2 r / s)^2 copies of
its cells and nothing for each place of the kernel.  A tile's work is array arithmetic
over its bounding box; its own cells come back as whole rows, so no join follows.

Rows: a cell of several rows counts with all of them and each row gets the result (all
rows of a cell meet in one task, so cells should be few rows each); NaN is no value; a
row without row or column takes no part and gets null; null keys are a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side of a tile in cells.
TILE = 256


class Tile:
    """One tile's cells as arrays over their bounding box and ``reach`` cells around it."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, home: np.ndarray, reach: int):
        self.reach, self.home = reach, home
        self.r0, self.c0 = rows[home].min() - reach, cols[home].min() - reach
        self.height, self.width = int(np.ptp(rows[home])) + 1, int(np.ptp(cols[home])) + 1
        self.shape = (self.height + 2 * reach, self.width + 2 * reach)
        r, c = rows - self.r0, cols - self.c0
        self.inside = (r >= 0) & (r < self.shape[0]) & (c >= 0) & (c < self.shape[1])
        self.place = (r * self.shape[1] + c).astype(np.int64)
        self.at_home = (r[home] - reach, c[home] - reach)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of the values of each cell's rows."""
        size = self.shape[0] * self.shape[1]
        return np.bincount(self.place[self.inside], values[self.inside], size).reshape(self.shape)

    def lowest(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.shape[0] * self.shape[1], np.inf)
        np.minimum.at(out, self.place[self.inside], values[self.inside])
        return out.reshape(self.shape)

    def shifted(self, a: np.ndarray, dr: int, dc: int) -> np.ndarray:
        """For the inner cells, what stands (dr, dc) beside them."""
        r, c = self.reach + dr, self.reach + dc
        return a[r : r + self.height, c : c + self.width]

    def own(self, a: np.ndarray) -> np.ndarray:
        """The inner array's values at the tile's own rows."""
        return a[self.at_home]


def applied(df: DataFrame, columns: list[str], reach: int, work: Callable, name: str | list[str], keys: list[str] = (), size: int = TILE) -> DataFrame:
    """``df`` with a column ``name``, a double, that ``work(tile, arrays)`` gives for a tile's own rows.

    arrays are the values of ``columns`` for all rows that the tile sees; what is no
    number in the result is null.  For several names, ``work`` gives a list of results.
    """
    names = [name] if isinstance(name, str) else name
    at = lambda c, d: F.floor((F.col(c) + d) / size).cast("long")
    seen = {f"_v{i}": F.col(c).cast("double") for i, c in enumerate(columns)} | {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    out = df.select(
        F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"),
        *[c.alias(n) for n, c in seen.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"),
        F.explode_outer(F.sequence(at("row", -reach), at("row", reach))).alias("_tr"), F.col("col"),
    )
    out = out.withColumn("_tc", F.explode_outer(F.sequence(at("col", -reach), at("col", reach)))).drop("col")
    home = F.floor(F.col("_row") / size).eqNullSafe(F.col("_tr")) & F.floor(F.col("_col") / size).eqNullSafe(F.col("_tc"))
    out = out.withColumn("_home", home).withColumn("_own", F.when(F.col("_home"), F.col("_own")))
    kind = T.StructType([T.StructField("_own", out.schema["_own"].dataType), *[T.StructField(f"_m{i}", T.DoubleType()) for i in range(len(names))]])

    def tile_rows(table: pa.Table) -> pa.Table:
        home = table["_home"].to_numpy(zero_copy_only=False).astype(bool)
        made = [np.full(int(home.sum()), np.nan)] * len(names)
        if home.any() and table["_row"][0].is_valid and table["_col"][0].is_valid:
            tile = Tile(table["_row"].to_numpy(), table["_col"].to_numpy(), home, reach)
            found = work(tile, [table[f"_v{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))])
            made = found if len(names) > 1 else [found]
        own = table["_own"].combine_chunks().filter(pa.array(home))
        return pa.table({"_own": own} | {f"_m{i}": pa.array(m, pa.float64(), from_pandas=True) for i, m in enumerate(made)})

    grouped = out.groupBy(*[f"_k{i}" for i in range(len(keys))], "_tr", "_tc")
    done = grouped.applyInArrow(tile_rows, kind)
    others = [c for c in df.columns if c not in names]
    return done.select(*[F.col("_own").getField(c).alias(c) for c in others], *[F.col(f"_m{i}").alias(n) for i, n in enumerate(names)])


def focal(df: DataFrame, kernel: list[tuple[int, int, float]], value: str, how: str = "mean", cover: float = 0.0, keys: list[str] = (), size: int = TILE) -> DataFrame:
    """Weighted mean or minimum over the kernel as ``{value}_focal``; null below a share ``cover`` of its weight."""
    whole = sum(k[2] for k in kernel)

    def work(tile: Tile, arrays: list[np.ndarray]) -> np.ndarray:
        there = ~np.isnan(arrays[0])
        if how == "min":
            low = tile.lowest(np.where(there, arrays[0], np.inf))
            made = np.full((tile.height, tile.width), np.inf)
            for dr, dc, _ in kernel:
                np.minimum(made, tile.shifted(low, dr, dc), out=made)
            return tile.own(np.where(np.isinf(made), np.nan, made))
        total, count = tile.total(np.where(there, arrays[0], 0.0)), tile.total(there.astype(float))
        up, weight = np.zeros((2, tile.height, tile.width))
        for dr, dc, w in kernel:
            up += w * tile.shifted(total, dr, dc)
            weight += w * tile.shifted(count, dr, dc)
        enough = (weight >= cover * whole) & (weight != 0)
        return tile.own(np.where(enough, up / np.where(weight == 0, 1, weight), np.nan))

    return applied(df, [value], max(max(abs(a), abs(b)) for a, b, _ in kernel), work, f"{value}_focal", keys, size)


def position_index(df: DataFrame, value: str, r: int, name: str = "tpi", keys: list[str] = (), size: int = TILE) -> DataFrame:
    """Value less the mean of its box of radius r, summed along rows, then along columns."""

    def work(tile: Tile, arrays: list[np.ndarray]) -> np.ndarray:
        there = ~np.isnan(arrays[0])
        sums = []
        for a in (tile.total(np.where(there, arrays[0], 0.0)), tile.total(there.astype(float))):
            along = sum(a[:, r + d : r + d + tile.width] for d in range(-r, r + 1))
            sums.append(sum(along[r + d : r + d + tile.height] for d in range(-r, r + 1)))
        mean = np.where(sums[1] > 0, sums[0] / np.maximum(sums[1], 1), np.nan)
        return arrays[0][tile.home] - tile.own(mean)

    return applied(df, [value], r, work, name, keys, size)


def seam_gap(df: DataFrame, label: str, reach: int, name: str = "gap", keys: list[str] = (), size: int = TILE) -> DataFrame:
    """Distance, within ``reach``, of each cell to the next cell of another label (a number)."""
    steps = sorted((a * a + b * b, a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if 0 < a * a + b * b <= reach * reach)

    def work(tile: Tile, arrays: list[np.ndarray]) -> np.ndarray:
        low = tile.lowest(np.where(np.isnan(arrays[0]), np.inf, arrays[0]))
        own, gap = tile.shifted(low, 0, 0), np.full((tile.height, tile.width), np.nan)
        for d2, a, b in steps:
            other = tile.shifted(low, a, b)
            gap[np.isnan(gap) & np.isfinite(other) & np.isfinite(own) & (other != own)] = d2**0.5
        return tile.own(gap)

    return applied(df, [label], reach, work, name, keys, size)


def ray_steps(azimuths: list[float], distances: list[float], cell: float, half: float = 15.0, rays: int = 3) -> list[tuple[int, int, int, int, float]]:
    """(azimuth's place, distance's place, rows, columns, metres) of each step along the rays of each sector.

    A step belongs to the shortest distance that reaches it; azimuths are degrees from
    north, rows go south.
    """
    out = []
    for i, azimuth in enumerate(azimuths):
        for angle in np.radians(np.linspace(azimuth - half, azimuth + half, rays) if rays > 1 and half > 0 else [azimuth]):
            for k in range(1, int((max(distances) - cell) / cell) + 2):
                reach = next(j for j, d in enumerate(distances) if k <= int((d - cell) / cell) + 1)
                out.append((i, reach, round(-math.cos(angle) * k), round(math.sin(angle) * k), k * cell))
    return out


def shelter(
    df: DataFrame, value: str, cell: float, azimuths: list[float], distances: list[float], half: float = 15.0, rays: int = 3, keys: list[str] = (), size: int = TILE
) -> DataFrame:
    """``df`` with the largest slope, rise over distance, seen from each cell in each sector up to each distance.

    Columns are sx_{azimuth}_{distance in km}k.  A running maximum goes out along the
    rays, and a shorter distance is read off on the way; cells without a value or beyond
    the grid are passed over, and where nothing is seen the result is 0.  ``distances``
    ascend.  A cell without a value has null.
    """
    steps = ray_steps(azimuths, distances, cell, half, rays)
    names = [f"sx_{int(a) % 360:03d}_{int(d // 1000)}k" for a in azimuths for d in distances]

    def work(tile: Tile, arrays: list[np.ndarray]) -> list[np.ndarray]:
        z = tile.lowest(np.where(np.isnan(arrays[0]), np.inf, arrays[0]))
        z[np.isinf(z)] = np.nan
        own, out = tile.shifted(z, 0, 0), []
        best = np.full((len(azimuths), len(distances), tile.height, tile.width), -np.inf)
        for i, j, dr, dc, metres in steps:
            np.fmax(best[i, j], (tile.shifted(z, dr, dc) - own) / metres, out=best[i, j])
        best = np.maximum.accumulate(best, axis=1)
        best = np.where(np.isinf(best), 0.0, best)
        out = [tile.own(np.where(np.isnan(own), np.nan, best[i, j])) for i in range(len(azimuths)) for j in range(len(distances))]
        return out if len(out) > 1 else out[0]

    return applied(df, [value], max(max(abs(s[2]), abs(s[3])) for s in steps), work, names, keys, size)


#: Rows and columns of a step along each of eight rays, clockwise from north.
RAYS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def rays(df: DataFrame, value: str, cell: float, steps: int, size: int = TILE) -> DataFrame:
    """(row, col, ray, sx): largest upward gradient along each of eight rays from each cell, 0 if there is none.

    Of a cell of several rows the lowest looks up, at the highest ones.
    """
    cells = df.groupBy("row", "col").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    names = [f"_r{i}" for i in range(len(RAYS))]

    def work(tile: Tile, arrays: list[np.ndarray]) -> list[np.ndarray]:
        own = tile.shifted(tile.lowest(np.where(np.isnan(arrays[0]), np.inf, arrays[0])), 0, 0)
        high, out = -tile.lowest(np.where(np.isnan(arrays[1]), np.inf, -arrays[1])), []
        for dr, dc in RAYS:
            best = np.zeros((tile.height, tile.width))
            for s in range(1, steps + 1):
                np.fmax(best, (tile.shifted(high, s * dr, s * dc) - own) / (s * cell * math.sqrt(abs(dr) + abs(dc))), out=best)
            out.append(tile.own(best))
        return out

    out = applied(cells, ["_lo", "_hi"], steps, work, names, size=size)
    return out.select("row", "col", F.posexplode(F.array(*[F.coalesce(n, F.lit(0.0)) for n in names])).alias("ray", "sx"))


def _steps(diagonal: bool) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])


def _local(rows: np.ndarray, cols: np.ndarray, kinds: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each cell of a tile the place of the first cell, in row order, of its connected ones of one kind."""
    r0, c0, height, width = rows.min(), cols.min(), int(np.ptp(rows)) + 1, int(np.ptp(cols)) + 1
    kind = np.full((height, width), -1, np.int64)
    kind[rows - r0, cols - c0] = kinds
    number = np.arange(height * width).reshape(height, width)
    a, b = [], []
    for dr, dc in _steps(diagonal):
        left, right = (slice(0, height - dr), slice(max(0, -dc), width - max(0, dc))), (slice(dr, height), slice(max(0, dc), width + min(0, dc)))
        same = (kind[left] == kind[right]) & (kind[left] >= 0)
        a.append(number[left][same])
        b.append(number[right][same])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(height * width)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:  # each points at its root again
            up = root[root]
            if (up == root).all():
                break
            root = up
    found = root[(rows - r0) * width + cols - c0]
    return found // width + r0, found % width + c0


def patches(df: DataFrame, value: str, width: int, diagonal: bool = True, size: int = TILE) -> DataFrame:
    """(row, col, value, patch): connected cells of equal value get the smallest cell id
    (row * width + col) of their patch.

    Labels are made inside each tile first; only cells at a tile's edge are joined with
    their neighbours across it, and components are sought among labels that meet there.
    """
    from .grid import connected

    ident = lambda r, c: (F.col(r) * width + F.col(c)).cast("long")
    cells = df.where(F.col(value).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull())
    cells = cells.select("row", "col", F.col(value).alias("k"), F.floor(F.col("row") / size).alias("_tr"), F.floor(F.col("col") / size).alias("_tc"))
    kind = T.StructType([*cells.schema.fields, T.StructField("_r", T.LongType()), T.StructField("_c", T.LongType())])

    def label(table: pa.Table) -> pa.Table:
        rows, cols = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        codes = table["k"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        r, c = _local(rows, cols, codes, diagonal)
        return table.append_column("_r", pa.array(r)).append_column("_c", pa.array(c))

    local = cells.groupBy("_tr", "_tc").applyInArrow(label, kind)
    local = local.select("row", "col", "k", ident("_r", "_c").alias("local")).checkpoint()
    edge = local.where((F.pmod("row", F.lit(size)).isin(0, size - 1)) | (F.pmod("col", F.lit(size)).isin(0, size - 1)))
    beside = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in _steps(diagonal)]))
    out = edge.select("row", "col", "k", "local", beside.alias("o")).select((F.col("row") + F.col("o.dr")).alias("row2"), (F.col("col") + F.col("o.dc")).alias("col2"), "row", "col", "k", "local")
    tile = lambda c: F.floor(F.col(c) / size)
    out = out.where((tile("row") != tile("row2")) | (tile("col") != tile("col2")))
    other = edge.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("k").alias("k2"), F.col("local").alias("v"))
    meet = out.join(other, ["row2", "col2"]).where("k = k2").select(F.col("local").alias("u"), "v")
    roots = connected(meet).select(F.col("node").alias("local"), "root")
    return local.join(roots, "local", "left").select("row", "col", F.col("k").alias(value), F.coalesce("root", "local").alias("patch"))


def borders(labelled: DataFrame, label: str = "patch", size: int = TILE) -> DataFrame:
    """(a, b, n): length of the border of each two labels (long) that touch, both ways, counted tile by tile."""
    at = lambda c, d: F.floor((F.col(c) + d) / size).cast("long")
    cells = labelled.where("row is not null and col is not null").select(
        F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(label).alias("p"), F.explode(F.sequence(at("row", -1), at("row", 1))).alias("_tr")
    )
    cells = cells.withColumn("_tc", F.explode(F.sequence(at("col", -1), at("col", 1))))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        rows, cols, p = (table[c].to_numpy().astype(np.int64) for c in ("row", "col", "p"))
        r, c = rows - rows.min(), cols - cols.min()
        grid = np.zeros((r.max() + 1, c.max() + 1), np.int64)
        there = np.zeros(grid.shape, bool)
        grid[r, c], there[r, c] = p, True
        home = np.zeros(grid.shape, bool)
        home[r, c] = (rows // size == key[0].as_py()) & (cols // size == key[1].as_py())
        pairs = []
        for dr, dc in _steps(False):
            one, two = (slice(0, len(grid) - dr), slice(0, grid.shape[1] - dc)), (slice(dr, None), slice(dc, None))
            both = there[one] & there[two] & (grid[one] != grid[two])
            for x, y in ((one, two), (two, one)):
                mine = both & home[x]
                pairs.append(np.column_stack([grid[x][mine], grid[y][mine]]))
        found, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "n": pa.array(n.astype(np.int64))})

    return cells.groupBy("_tr", "_tc").applyInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
