"""Rasters as tables of cells (row, col, value): kernels, terrain, components, layers.

Kernels over a neighbourhood, labels and borders are in ``halo``; the 3 x 3 of a slope
is an array of offsets beside each cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import aspect_class
from ..shared import shuffled
from .halo import borders, focal, patches, position_index  # noqa: F401


def offsets(spark, cells: list[tuple[int, int, float]]) -> Column:
    """The kernel as an array of structs, to explode beside each cell."""
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(w)).alias("w")) for a, b, w in cells])


def disc(r: int, weight=lambda d2: 1.0) -> list[tuple[int, int, float]]:
    return [(a, b, weight(a * a + b * b)) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


def box(r: int) -> list[tuple[int, int, float]]:
    return [(a, b, 1.0) for a in range(-r, r + 1) for b in range(-r, r + 1)]


def slope_aspect(df: DataFrame, value: str, size: float) -> DataFrame:
    """Horn slope (degrees) and aspect (degrees clockwise from north, -1 where flat); edges repeat."""
    ends = df.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    near = [(a, b, 0.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    base = df.select("row", "col").join(F.broadcast(ends), F.lit(True))  # one row
    want = base.withColumn("o", F.explode(offsets(None, near)))
    clamp = lambda x, a, b: F.least(F.greatest(x, a), b)
    want = want.select(
        "row", "col", "o.dr", "o.dc",
        clamp(F.col("row") + F.col("o.dr"), F.col("r0"), F.col("r1")).alias("r"),
        clamp(F.col("col") + F.col("o.dc"), F.col("c0"), F.col("c1")).alias("c"),
    )
    z = df.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("z"))
    met = want.join(z, ["r", "c"], "left").groupBy("row", "col")
    at = lambda a, b: F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col("z")))
    dx = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) / (8 * size)
    dy = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) / (8 * size)
    out = met.agg(dx.alias("dx"), dy.alias("dy"))
    steep = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    turned = F.degrees(F.atan2(-F.col("dx"), F.col("dy")))
    aspect = F.when(steep < 1e-12, F.lit(-1.0)).when(turned < 0, turned + 360).otherwise(turned)
    return out.select("row", "col", F.degrees(F.atan(steep)).alias("slope"), aspect.alias("aspect"))


def coarsened(df: DataFrame, value: str, factor: int, how: str = "average") -> DataFrame:
    """Means or modes (smallest of the most frequent) of factor x factor blocks."""
    key = [F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")]
    if how == "average":
        return df.groupBy(*key).agg(F.avg(value).alias(value))
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def bilinear(df: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """points(id, y, x) in cell units: the four corners' weighted mean over those that are there."""
    r, c = F.floor("y").cast("int"), F.floor("x").cast("int")
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
    p = points.select("id", "y", "x", corners)
    p = p.withColumns({"row": r + F.col("k.a"), "col": c + F.col("k.b")})
    w = (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col")))
    met = p.withColumn("w", w).join(df.select("row", "col", value), ["row", "col"]).where(F.col(value).isNotNull())
    return met.groupBy("id").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0.0))).alias(value))


def adjacency(df: DataFrame, diagonal: bool = False, values: list[str] = ()) -> DataFrame:
    """(row, col, row2, col2) of neighbouring cells that are both there, both ways; with the ``values`` of
    the cell and, as {value}2, of the other one."""
    steps = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    a = df.select("row", "col", *values, F.explode(offsets(None, steps)).alias("o"))
    a = a.select("row", "col", *values, (F.col("row") + F.col("o.dr")).alias("row2"), (F.col("col") + F.col("o.dc")).alias("col2"))
    other = [f"{c}2" for c in values]
    b = df.select(*[F.col(c).alias(f"{c}2") for c in ("row", "col", *values)])
    return a.join(shuffled(b), ["row2", "col2"]).select("row", "col", "row2", "col2", *values, *other)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of ``edges(u, v)`` long: root is the smallest node of the component.

    Alternating large-star and small-star steps, written to the checkpoint folder; the
    number of rounds grows with the logarithm of the nodes, and they end when a
    round changes nothing.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state, before = digest(pairs), None
    while state != before:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.unionByName(first.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        state, before = digest(pairs), state
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def merged_small(labelled: DataFrame, least: int | str, kind: str | None = None) -> DataFrame:
    """Patches below ``least`` cells join the neighbour of the longest border (ties: the
    nearest direction where ``kind`` names a column of classes, then the smallest id) and
    take its id, smallest (size, id) first, until none has a neighbour.  ``least`` may
    name a column that is the same in all patches that touch.

    A round merges each small patch that comes before all its small neighbours, which
    gives the same as one merge after the other; only patches and borders are carried
    from round to round, by way of the checkpoint folder.
    """
    bound = F.max(least) if isinstance(least, str) else F.lit(least)
    sizes = labelled.groupBy("patch").agg(F.count("*").alias("size"), bound.alias("least")).checkpoint()
    edges = borders(labelled).checkpoint()
    gap = F.lit(0)
    if kind:  # of the patch that an id was first given to
        kinds = labelled.groupBy("patch").agg(F.max(kind).alias("kind")).checkpoint()
        gap = turn(F.col("ka"), F.col("kb"))
    names = sizes.select("patch", F.col("patch").alias("now")).checkpoint()
    while True:
        small = sizes.where(F.col("size") < F.col("least"))
        first = edges.join(small.select(F.col("patch").alias("a"), F.col("size").alias("sa")), "a")
        first = first.join(small.select(F.col("patch").alias("b"), F.col("size").alias("sb")), "b", "left")
        late = F.coalesce(F.struct("sb", "b") < F.struct("sa", "a"), F.lit(False)) & F.col("sb").isNotNull()
        if kind:
            first = first.join(kinds.select(F.col("patch").alias("a"), F.col("kind").alias("ka")), "a").join(kinds.select(F.col("patch").alias("b"), F.col("kind").alias("kb")), "b")
        best = F.max(F.struct("n", (-gap).alias("g"), (-F.col("b")).alias("m")))
        moves = first.groupBy("a").agg(F.max(late.cast("int")).alias("late"), best.alias("t"))
        moves = moves.where("late = 0").select("a", (-F.col("t.m")).alias("to")).checkpoint()
        if not moves.head(1):
            break
        renamed = lambda df, c: df.join(moves.withColumnRenamed("a", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        sizes = renamed(sizes, "patch").groupBy("patch").agg(F.sum("size").alias("size"), F.max("least").alias("least")).checkpoint()
        edges = renamed(renamed(edges, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")).checkpoint()
        names = renamed(names, "now").checkpoint()
    return labelled.join(names, "patch", "left").withColumn("patch", F.coalesce("now", "patch")).drop("now")


def facet_scales(df: DataFrame, value: str, size: float, scales: list[tuple[float, int]], width: int, flat: float = 2.0, diagonal: bool = True) -> DataFrame:
    """(scale, row, col, kind, facet): facets of a surface at each (radius, least cells).

    The surface is smoothed by a Gaussian of half the radius, cut at the radius; cells of
    one direction that touch are a facet, and small facets merge.  Cells without a slope
    drop out.  ``width`` is the number of columns.  The scales lie below each other in
    one grid, so that labels and merges take as many rounds as the slowest scale alone.
    """
    ends = df.agg(F.min("row").alias("r0"), F.max("row").alias("r1")).first()
    stride, stacked = (ends.r1 - ends.r0 + 2 if ends.r0 is not None else 1), None
    low = ends.r0 or 0
    for i, (radius, least) in enumerate(scales):
        reach = (radius / size) ** 2
        kernel = disc(math.ceil(radius / size), lambda d2, reach=reach: math.exp(-2 * d2 / reach))
        kernel = [k for k in kernel if k[0] ** 2 + k[1] ** 2 <= reach]
        smooth = focal(df.select("row", "col", value), kernel, value).select("row", "col", F.col(f"{value}_focal").alias(value))
        t = slope_aspect(smooth, value, size).where(F.col("slope").isNotNull())
        kind = F.when(F.col("slope") < flat, F.lit(0)).otherwise(aspect_class(F.col("aspect")))
        part = t.select((F.col("row") - low + i * stride).alias("row"), "col", kind.alias("kind"), F.lit(i).alias("scale"), F.lit(least).alias("least"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = stacked.checkpoint()
    first = patches(stacked, "kind", width, diagonal).join(stacked.select("row", "col", "scale", "least"), ["row", "col"]).checkpoint()
    merged = merged_small(first, "least", "kind").withColumnRenamed("patch", "facet").drop("kind")
    kinds = first.groupBy(F.col("patch").alias("facet")).agg(F.max("kind").alias("kind"))
    return merged.join(kinds, "facet").select("scale", (F.col("row") + low - F.col("scale") * stride).alias("row"), "col", "kind", "facet")


def turn(a: Column, b: Column) -> Column:
    """Steps of 45 degrees between two direction classes; 4 where one is flat."""
    d = F.abs(a - b)
    return F.when((a == 0) | (b == 0), F.lit(4)).otherwise(F.least(d, 8 - d))


def climatology_fill(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nulls as the mean of their group; a null key is a group of its own."""
    group = F.struct(*keys)
    means = df.groupBy(group.alias("_k")).agg(F.avg(value).alias("_m"))
    out = df.withColumn("_k", group).join(means, "_k", "left")
    return out.select(*[F.coalesce(value, "_m").alias(c) if c == value else c for c in df.columns])


def tiles(df: DataFrame, stride: int, keys: list[str] = ()) -> DataFrame:
    r0, c0 = F.floor(F.col("row") / stride) * stride, F.floor(F.col("col") / stride) * stride
    return df.groupBy(*keys, r0.alias("r0"), c0.alias("c0")).agg(F.count("*").alias("n"))


def layer_checks(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """(check, ok, detail) rows from one pass over the layer."""
    a = df.agg(F.count("*").alias("n"), F.count(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = F.array(
        F.struct(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("ok"), F.col("n").cast("double").alias("detail")),
        F.struct(F.lit("has_values").alias("check"), (F.col("v") > 0).alias("ok"), F.col("v").cast("double").alias("detail")),
        F.struct(F.lit("low").alias("check"), (F.col("lo") >= low).alias("ok"), F.col("lo").alias("detail")),
        F.struct(F.lit("high").alias("check"), (F.col("hi") <= high).alias("ok"), F.col("hi").alias("detail")),
    )
    return a.select(F.inline(rows))
