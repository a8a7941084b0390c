"""Exact quantiles of counted values, without a buffer of all values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Edges of more groups are joined without a broadcast.
MANY = 100_000


def quantiles(df: DataFrame, keys: list[str], column: str, at: list[float], discrete: bool = False, edges: int = 32) -> DataFrame:
    """(keys, q, n): the exact quantiles ``at`` of each group's values, and their number.

    Linear between the two next values, or with ``discrete`` the value of rank
    ceil(p n).  The table is read once: rows are counted by value, which tasks do before
    they shuffle, and written to the checkpoint folder.  A sketch of the distinct values
    cuts each group into bins; their counts tell which bins hold an asked rank, and only
    these are put in order, so no task orders a group.  The ranks come from counts, so
    the result is exact whatever the sketch's error.  Nulls are left out; a group without
    values has no row; a null key is a group of its own.
    """
    shared_dir(df.sparkSession)
    group = F.struct(*keys) if keys else F.lit(0)
    rows = df.select(group.alias("_k"), F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL")
    values = rows.groupBy("_k", "_x").agg(F.count("*").alias("_n")).checkpoint()
    levels = [i / edges for i in range(edges + 1)]
    cuts = values.groupBy("_k").agg(F.array_distinct(F.percentile_approx("_x", levels, 1000)).alias("_e"), F.sum("_n").alias("n")).checkpoint()
    cuts = F.broadcast(cuts) if cuts.count() <= MANY else cuts
    # a plain sum is compiled, a lambda is not
    edge = sum((F.coalesce((F.get("_e", F.lit(i)) <= F.col("_x")).cast("int"), F.lit(0)) for i in range(len(levels))), F.lit(0))
    cut = values.join(cuts, "_k").select("_k", "_x", "_n", "n", edge.alias("_b"))

    bins = cut.groupBy("_k", "_b").agg(F.sum("_n").alias("_n"), F.max("n").alias("n"))  # a few rows a group
    bins = bins.withColumn("_to", F.sum("_n").over(Window.partitionBy("_k").orderBy("_b")))
    places = []
    for i, p in enumerate(at):
        if discrete:
            rank = F.greatest(F.ceil(F.lit(Decimal(str(p))) * F.col("n")).cast("long") - 1, F.lit(0))
            parts = [(rank, F.lit(1.0))]
        else:
            place = F.lit(float(p)) * (F.col("n") - 1)
            low = F.floor(place)
            parts = [(low, 1 - (place - low)), (low + 1, place - low)]
        places += [F.struct(F.lit(i).alias("i"), rank.alias("rank"), weight.alias("w")) for rank, weight in parts]
    asked = bins.withColumn("_p", F.explode(F.array(*places)))
    asked = asked.where((F.col("_p.w") > 0) & (F.col("_p.rank") >= F.col("_to") - F.col("_n")) & (F.col("_p.rank") < F.col("_to")))
    asked = asked.select("_k", "_b", "n", "_p.i", "_p.w", (F.col("_p.rank") - F.col("_to") + F.col("_n")).alias("rank"))

    inside = cut.select("_k", "_b", "_x", "_n").join(asked.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi")
    inside = inside.withColumn("_to", F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_x")))
    found = inside.join(asked, ["_k", "_b"]).where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_n")))
    each = found.groupBy("_k", "i").agg(F.sum(F.col("w") * F.col("_x")).alias("q"), F.max("n").alias("n"))
    out = each.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("_q"), F.max("n").alias("n"))
    return out.select(*[F.col(f"_k.{c}") for c in keys], F.transform("_q", lambda s: s["q"]).alias("q"), "n")


def one_row(long: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    """One row with an array ``_{c}`` of quantiles for each column of ``long(col, x)``; null for one without values."""
    found = quantiles(long, ["col"], "x", at)
    return found.agg(*[F.max(F.when(F.col("col") == c, F.col("q"))).alias(f"_{c}") for c in columns])
