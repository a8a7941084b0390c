"""A table merged by key from batches that rewrites only the partitions a batch touches.

``data/batch=N/_part=P`` holds the rows of partition P as batch N left them;
``commits/N`` lists, for each partition, the batch that wrote it last.  A batch reads the
partitions of its own rows, merges, writes them under its number and then its commit.
Readers go by commits, so a batch that broke off leaves nothing behind that is seen, and
a repeated one writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import keep_last

#: Commits of more partitions are joined without a broadcast.
MANY = 100_000


class UpsertTable:
    """Rows by ``keys``; ``part``, one of the keys, names the partition, ``order`` tells which row of a batch is newer.

    A null partition value and an empty one share a partition.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], part: str):
        if part not in keys:
            raise ValueError("the partition column must be one of the keys, or a row could stay behind in another partition")
        self.spark, self.path, self.keys, self.order, self.part = spark, path, keys, order, part

    def _files(self, path: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def commits(self) -> list[int]:
        """Numbers of the batches that are whole, ascending."""
        return [int(n) for n in self._files(f"{self.path}/commits") if "_SUCCESS" in self._files(f"{self.path}/commits/{n}")]

    def _commit(self, number: int) -> DataFrame:
        return self.spark.read.schema("_part string, batch long").parquet(f"{self.path}/commits/{number:09d}")

    def _rows(self, batches: list[int], number: int) -> DataFrame:
        """All rows that some batches wrote, with _part and batch."""
        schema = self.spark.read.parquet(f"{self.path}/schemas/{number:09d}").schema
        read = self.spark.read.schema(schema.add("batch", "long").add("_part", "string")).option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/data/batch={b}" for b in batches])

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges batch ``number``; for foreachBatch."""
        newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), F.struct(*self.order)).alias("row")
        new = batch.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(newest).select("row.*")
        new = new.withColumn("_part", F.concat(F.lit("p"), F.coalesce(F.col(self.part).cast("string"), F.lit(""))))
        touched = [r["_part"] for r in new.select("_part").distinct().collect()]
        merged, before = new, None
        if number:
            if number - 1 not in self.commits():
                raise ValueError(f"batch {number} has no predecessor in {self.path}; nothing is written, so that no history is lost")
            before = self._commit(number - 1)
            held = before.where(F.col("_part").isin(touched)).collect()
            if held:
                old = self._rows(sorted({r["batch"] for r in held}), number - 1)
                places = F.array(*[F.struct(F.lit(r["_part"]).alias("p"), F.lit(r["batch"]).alias("b")) for r in held])
                pruned = old.where(F.col("_part").isin([r["_part"] for r in held]))
                old = pruned.where(F.array_contains(places, F.struct(F.col("_part").alias("p"), F.col("batch").alias("b"))))
                merged = keep_last(old.drop("batch"), new, self.keys)
        folder = f"{self.path}/data/batch={number}"
        merged.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(folder)
        merged.drop("_part").limit(0).write.mode("overwrite").parquet(f"{self.path}/schemas/{number:09d}")
        made = self.spark.createDataFrame([(p, number) for p in touched], "_part string, batch long")
        after = made if before is None else before.where(~F.col("_part").isin(touched)).unionByName(made)
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number:09d}")

    def read(self) -> DataFrame:
        """The table as the last whole batch left it."""
        last = self.commits()[-1]
        commit = self._commit(last)
        batches = [r["batch"] for r in commit.select("batch").distinct().collect()]
        if not batches:
            return self.spark.read.parquet(f"{self.path}/schemas/{last:09d}")
        small = commit.count() <= MANY
        rows = self._rows(sorted(batches), last)
        return rows.join(F.broadcast(commit) if small else commit, ["_part", "batch"], "left_semi").drop("_part", "batch")

    def sweep(self) -> int:
        """Removes partitions and commits that the last two batches no longer need; returns the number of partitions."""
        last = self.commits()[-2:]
        needed = {(r["batch"], r["_part"]) for n in last for r in self._commit(n).collect()}
        gone = 0
        for folder in self._files(f"{self.path}/data"):
            number = int(folder.removeprefix("batch="))
            if last and number > last[-1]:
                continue  # of a batch that is being written
            for part in self._files(f"{self.path}/data/{folder}"):
                name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part).removeprefix("_part=")
                if part.startswith("_part=") and (number, name) not in needed:
                    self._remove(f"{self.path}/data/{folder}/{part}")
                    gone += 1
        for n in self.commits()[:-2]:
            self._remove(f"{self.path}/commits/{n:09d}")
            self._remove(f"{self.path}/schemas/{n:09d}")
        return gone
