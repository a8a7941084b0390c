"""How the given tables stand in for stations, observations, grids and sensors.

Each binding exists twice: as a DataFrame and as the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        k.alias("fid"),
        (42 + ((k * 7919) % 70000) / 10000.0).alias("lat"),
        (-125 + ((k * 104729) % 210000) / 10000.0).alias("lon"),
        ((k * 31) % 3000).cast("double").alias("elev"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("bal"),
        F.col("c_mktsegment").alias("segment"),
    )


ST = """st AS (SELECT c_custkey AS fid, 42 + ((c_custkey * 7919) % 70000) / 1e4 AS lat,
  -125 + ((c_custkey * 104729) % 210000) / 1e4 AS lon, CAST((c_custkey * 31) % 3000 AS DOUBLE) AS elev,
  c_name AS name, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment FROM customer)"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    a = F.radians(((F.col("event_id") * 37) % 360).cast("double"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("fid"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), "value",
        "event_type", "event_id", "props", (F.col("value") * F.cos(a)).alias("u"), (F.col("value") * F.sin(a)).alias("v"),
    )


EV = """ev AS (SELECT user_id AS fid, ts, CAST(ts AS DATE) AS day, value, event_type, event_id, props,
  value * cos(radians((event_id * 37) % 360)) AS u, value * sin(radians((event_id * 37) % 360)) AS v FROM events)"""


def daily_obs(spark: SparkSession, folder: str) -> DataFrame:
    """(fid, day, obs, top, low, n, base, delta): daily values, the day's mean as baseline, residual."""
    d = hourly(spark, folder).groupBy("fid", "day")
    d = d.agg(F.avg("value").alias("obs"), F.max("value").alias("top"), F.min("value").alias("low"), F.count("*").alias("n"))
    b = d.groupBy("day").agg(F.avg("obs").alias("base"))
    return d.join(b, "day").select("fid", "day", "obs", "top", "low", "n", "base", (F.col("obs") - F.col("base")).alias("delta"))


DD = EV + """, d0 AS (SELECT fid, day, avg(value) AS obs, max(value) AS top, min(value) AS low, count(*) AS n FROM ev GROUP BY 1, 2),
b0 AS (SELECT day, avg(obs) AS base FROM d0 GROUP BY 1),
dd AS (SELECT fid, d0.day, obs, top, low, n, base, obs - base AS delta FROM d0 JOIN b0 ON d0.day = b0.day)"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.col("p_retailprice").alias("z"), F.col("p_size").alias("k")
    )


GR = "gr AS (SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, p_retailprice AS z, p_size AS k FROM part)"


def sensors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("day"),
    )


SE = """se AS (SELECT l_returnflag AS channel, l_quantity AS a, l_extendedprice / 1000 AS b, l_orderkey AS k,
  l_linenumber AS line, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, as the SQL does."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
