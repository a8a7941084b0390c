"""Sinks: station-day tables, per-station splits, merges, resumes, reports, artifacts."""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_dir


def write_station_days(df: DataFrame, path: str) -> None:
    """Ranges of stations, sorted by station and day inside a file."""
    df.repartitionByRange("fid").sortWithinPartitions("fid", "day").write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: list[str], order: list[str] = ()) -> DataFrame:
    """A table in buckets of its keys, sorted inside; joins and groups by these keys read it without an exchange.

    Rows are dealt to the buckets before they are written, so that a bucket is one file.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table)
    return df.sparkSession.table(table)


def write_by_station(df: DataFrame, path: str, key: str = "fid") -> None:
    """One folder a station; only the stations at hand are replaced.

    The rows are few beside the files, so the number of tasks is given: by size alone, a
    few tasks would make the files of all stations.  In a folder of the file system that all
    share, with whole numbers as keys, the tasks write the files themselves: there Hadoop's writer starts
    processes for each file, which takes far longer than the file.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    dealt = df.repartition(tasks, key)
    if uri.getScheme() == "file" and dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        _write_folders(dealt.sortWithinPartitions(key), uri.getPath(), key, tasks)
    else:
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def _write_folders(df: DataFrame, path: str, key: str, tasks: int) -> None:
    """Each station's rows, which stand together, as one Parquet file; all files are written aside, then the folders change places."""
    name = uuid.uuid4().hex
    aside = f"{path}/.staging-{name}"

    def write(batches):
        task = TaskContext.get()
        attempt, last, writer, at = task.taskAttemptId(), object(), None, None

        def done():
            writer.close()
            os.replace(f"{at}/.{attempt}", f"{at}/part-{task.partitionId():05d}-{name}.snappy.parquet")

        for batch in batches:
            table = pa.Table.from_batches([batch])
            column = table[key].combine_chunks()
            values, none = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((values[1:] != values[:-1]) | (none[1:] != none[:-1])) + 1
            rows, made = table.drop_columns([key]), []
            for i, j in zip([0, *ends], [*ends, len(values)], strict=True):
                station = column[i].as_py() if j > i else last
                if station != last:
                    if writer:
                        done()
                    last, folder = station, f"{key}={'__HIVE_DEFAULT_PARTITION__' if station is None else station}"
                    made.append(folder)
                    at = f"{aside}/new/{folder}"
                    os.makedirs(at, exist_ok=True)
                    writer = pq.ParquetWriter(f"{at}/.{attempt}", rows.schema)
                if j > i:
                    writer.write_table(rows.slice(i, j - i))
            yield pa.RecordBatch.from_pydict({"folder": pa.array(made, pa.string())})
        if writer:
            done()

    def change(batches):
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                new, old, at = f"{aside}/new/{folder}", f"{aside}/old/{folder}", f"{path}/{folder}"
                if os.path.isdir(new):  # else an earlier attempt was here
                    if os.path.isdir(at):
                        os.makedirs(f"{aside}/old", exist_ok=True)
                        os.replace(at, old)
                    os.replace(new, at)
                    shutil.rmtree(old, ignore_errors=True)
            yield batch

    os.makedirs(path, exist_ok=True)
    shared_dir(df.sparkSession)
    try:
        folders = df.mapInArrow(write, "folder string").checkpoint()
    except Exception:
        shutil.rmtree(aside, ignore_errors=True)
        raise
    # should this fail, what stands aside is not removed: a folder may have no other copy
    folders.repartition(tasks).mapInArrow(change, "folder string").write.format("noop").mode("overwrite").save()
    shutil.rmtree(aside, ignore_errors=True)
    with open(f"{path}/_SUCCESS", "w"):
        pass


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables with the newer row of each key."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


def overlay(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], flag: str = "repeated") -> DataFrame:
    """New values over old ones; where there is a new row, the flag is reset."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    out = old.join(n, keys, "full_outer")
    out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns} | {flag: F.when(F.col("_new"), F.lit(0)).otherwise(F.col(flag))})
    return out.drop("_new", *[f"_{c}" for c in columns])


def days_to_do(wanted: DataFrame, done: DataFrame, stations: int) -> DataFrame:
    """Wanted days that not all stations have yet."""
    full = done.groupBy("day").agg(F.count_distinct("fid").alias("n")).where(F.col("n") >= stations).select("day")
    return wanted.join(full, "day", "left_anti")


def missing_inputs(stations: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """(fid, dataset) of each station that an input lacks."""
    out = None
    for name, df in inputs.items():
        part = stations.select("fid").distinct().join(df.select("fid").distinct(), "fid", "left_anti").withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def dense_matrix(df: DataFrame, value: str, start: str, end: str) -> DataFrame:
    """(fid, series): values of every day from start to end, null where there is none."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day")
    rows = df.select("fid").distinct().select("fid", days).join(df.select("fid", "day", value), ["fid", "day"], "left")
    pairs = F.array_sort(F.collect_list(F.struct("day", value)))
    return rows.groupBy("fid").agg(F.transform(pairs, lambda p: p[value]).alias("series"))


def write_artifact(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
