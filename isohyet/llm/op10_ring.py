"""Consistent-hash ring with virtual nodes and bounded loads, from SQL functions only.

The ring is cut into ``cells`` equal arcs.  Each shard owns ``nodes`` points on it; a
row's hash gives its cell, and the first point clockwise gives its home.  A shard
takes rows up to its load; the rows of a cell that it cannot take go on clockwise to
the next point.  Without slack, loads are n // shards, and one more for the first
n % shards shards by demand: the counts of any two shards differ by one at most (law
``rows``).  With slack, a shard takes up to 1 + slack times the mean (law
``bounded``), and far fewer rows move when a shard is added.

The walk is made on the counts of cells, whose number is a parameter and not the
data's; rows then find their place with an equi join and their rank in the cell.

Rows: a null text has no bytes; null doc_ids, repeated rows and ties are rows like
others, ranked by doc_id, checksum and size; rows alike in these are one row with a
count until they have their places; extra columns are ignored; an empty table gives
no row.
"""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 16_384
#: Rows alike that one task gives their places.
CHUNK = 100_000


def ring(shards: int, nodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Sorted points (cell, shard); a shard's points do not depend on the others."""
    points = []
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big") % cells, shard))
    return sorted(points)


def walk(counts: dict[int, int], shards: int, nodes: int, cells: int = CELLS, slack: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, shard, first slot) of each run of rows.

    In each round the rows that still wait stand at a point; its shard takes what its
    load allows, cell by cell, and the rest moves on to the next point.
    """
    points, total = ring(shards, nodes, cells), sum(counts.values())
    at = {c: bisect_left(points, (c, -1)) % len(points) for c in counts}
    demand = [0] * shards
    for c, n in counts.items():
        demand[points[at[c]][1]] += n
    if slack:
        free = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        free = [total // shards] * shards
        for shard in sorted(range(shards), key=lambda s: (-demand[s], s))[: total % shards]:
            free[shard] += 1
    used, done, waiting, runs = [0] * shards, dict.fromkeys(counts, 0), sorted(c for c in counts if counts[c]), []
    while waiting:
        still = []
        for c in waiting:
            shard = points[at[c]][1]
            take = min(free[shard], counts[c] - done[c])
            if take:
                runs.append((c, done[c], shard, used[shard]))
                free[shard] -= take
                used[shard] += take
                done[c] += take
            if done[c] < counts[c]:
                at[c] = (at[c] + 1) % len(points)
                still.append(c)
        waiting = still
    return runs


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds the rank of each row in its cell; groups of rows alike are numbered in chunks."""
    key = ["cell", "doc_id", "text_crc32", "size"]
    order = Window.partitionBy("cell").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    groups = groups.withColumn("first", F.sum("n").over(order) - F.col("n"))
    few = groups.where(F.col("n") <= CHUNK).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    many = groups.where(F.col("n") > CHUNK).withColumn("chunk", chunk).repartition(*key, "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1
    many = many.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk")
    return few.unionByName(many).withColumn("rank", F.col("first") + F.col("i"))


def sharded(docs: DataFrame, shards: int = 40, nodes: int = 128, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # as many rows as the ring has cells
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for c, first, shard, slot in walk(counts, shards, nodes, cells, slack):
        runs.setdefault(c, []).append((first, shard, slot))
    table = json.dumps([{"cell": c, "runs": [{"first": a, "shard": s, "slot": b} for a, s, b in v]} for c, v in runs.items()])
    kind = "array<struct<cell:int,runs:array<struct<first:long,shard:int,slot:long>>>>"
    places = spark.range(1).select(F.inline(F.from_json(F.lit(table), kind)))
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    return (
        _ranked(rows)
        .join(F.broadcast(places), "cell")
        .withColumn("run", run)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bounded" if slack else "rows").alias("law"),
            F.col("run.shard").alias("shard"),
            (F.col("run.slot") + F.col("rank") - F.col("run.first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op10_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
