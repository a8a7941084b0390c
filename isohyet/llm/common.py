"""Shared helpers: stage boundaries and link components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_PASSING: list[list[str]] = []


@contextmanager
def passing() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``materialise`` writes inside are removed at the end.

    Gives a function that writes a table which stays.
    """
    _PASSING.append([])
    try:
        yield lambda df, label: materialise(df, label, stays=True)
    finally:
        from .store import remove

        for path in _PASSING.pop():
            remove(path)


def materialise(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without redoing what
    came before.  The shuffle files of the finished job are released at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    levels = _PASSING[:-1] if stays else _PASSING
    if levels:
        levels[-1].append(path)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as (node, root).

    root is the smallest node of the component.  Alternating large-star and
    small-star steps; each step is an aggregate and an equi join, so no node's
    neighbours are gathered in one place.  Stops when all components are stars around
    their smallest node: edges lead down, so a node without one below it is the smallest.
    """
    with passing() as keep:
        pairs = _starred(edges, label)
        roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
        return keep(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), label)


def _starred(edges: DataFrame, label: str) -> DataFrame:
    """(u, v): each node beside the smallest one of its component."""
    pairs = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label
    )

    def stars(df: DataFrame) -> bool:
        """Every u has one v, and no v is a u."""
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
        nodes = df.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
        return not nodes.where("ups > 1 or (ups = 1 and low = 0)").head(1)

    while not stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(first.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialise(small, label)
    return pairs
