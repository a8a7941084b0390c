"""Gridded products as a Python data source, and layers assembled from several of them."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


class Day(InputPartition):
    """One day's files."""

    def __init__(self, day: dt.date, files: list[str]):
        super().__init__(day)
        self.day, self.files = day, files


class GridReader(DataSourceReader):
    """A partition for each day that the options and the tests on the day leave."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.names = dict(x.split("=") for x in options.get("columns", "").split(",") if x)  # own name -> canonical one
        self.suffix, self.tests = options["product"], []
        for option, test in (("first", lambda a, b: a >= b), ("last", lambda a, b: a <= b)):
            if option in options:
                self.tests.append((test, dt.date.fromisoformat(options[option])))

    def partitions(self) -> list[Day]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        found: dict[dt.date, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(path, recursive=True)):
            part = os.path.basename(os.path.dirname(info.path))
            if info.path.endswith(".parquet") and part.startswith("day="):
                found.setdefault(dt.date.fromisoformat(part[4:]), []).append(info.path)
        return [Day(d, sorted(files)) for d, files in sorted(found.items()) if all(test(d, v) for test, v in self.tests)]

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition is None:  # no day is left
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        from pyspark.sql.pandas.types import to_arrow_schema

        own = {f"{self.names.get(c, c)}_{self.suffix}": c for c in self.names} | {c: c for c in ("row", "col")}
        schema = to_arrow_schema(self.schema)
        for name in partition.files:
            with system.open_input_file(name) as data:
                for batch in pq.ParquetFile(data).iter_batches(columns=[own[f.name] for f in schema if f.name != "day"]):
                    columns = [pa.array([partition.day] * len(batch), pa.date32()) if f.name == "day" else batch.column(own[f.name]).cast(f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)


class PushingReader(GridReader):
    """The same with the filters of the query, which Spark hands over only where its setting says so."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of the day; the others are Spark's."""
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in tests and f.attribute == ("day",):
                self.tests.append((tests[type(f)], f.value))
            else:
                yield f


class GridSource(DataSource):
    """``spark.read.format("daily_grid")``: daily grids under ``path``/day=YYYY-MM-DD.

    Options: path, product (the suffix of its columns) and columns, "own=canonical,...";
    first and last bound the days.  Rows are (day, row, col, {canonical}_{product} double
    ...).  Days are partitions.  With pushdown=true, filters on the day leave only theirs;
    that asks for Spark's ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_grid"

    def schema(self) -> str:
        names = [x.split("=")[1] for x in self.options["columns"].split(",")]
        return "day date, row int, col int, " + ", ".join(f"`{n}_{self.options['product']}` double" for n in names)

    def reader(self, schema: StructType) -> GridReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else GridReader
        return kind(schema, dict(self.options))


def available_range(days: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day of a product."""
    return tuple(days.agg(F.min("day"), F.max("day")).first())


class DayLayer:
    """A layer by day, from sources in order of priority, that builds only days whose sources changed.

    ``layer/day=...`` holds the cells, ``done/N`` the digest of each day's sources as run
    N left them.  A run that breaks off before its digests are written is done again.
    """

    def __init__(self, spark: SparkSession, path: str, bands: list[str]):
        self.spark, self.path, self.bands, self.run = spark, path, bands, 0

    def done(self) -> DataFrame:
        if not self.run:
            return self.spark.createDataFrame([], "day date, digest decimal(38,0)")
        return self.spark.read.schema("day date, digest decimal(38,0)").parquet(f"{self.path}/done/{self.run}")

    def build(self, sources: list[DataFrame]) -> DataFrame:
        """Brings the layer up to date with sources(day, row, col, bands); gives the days that were built.

        A band of a cell comes from the first source that has a value.
        """
        both = None
        for i, df in enumerate(sources):
            part = df.select("day", "row", "col", *[F.col(c).cast("double").alias(c) for c in self.bands], F.lit(i).alias("place"))
            both = part if both is None else both.unionByName(part)
        digest = F.sum(F.xxhash64("place", "row", "col", *self.bands).cast("decimal(38,0)")).alias("digest")
        now = both.groupBy("day").agg(digest).checkpoint()
        changed = now.join(self.done().withColumnRenamed("digest", "before"), "day", "left").where(~F.col("digest").eqNullSafe(F.col("before"))).select("day").checkpoint()
        if changed.head(1):
            first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in self.bands]
            cells = both.join(changed, "day", "left_semi").groupBy("day", "row", "col").agg(*first)
            cells = cells.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            cells.partitionBy("day").parquet(f"{self.path}/layer")
        now.write.mode("overwrite").parquet(f"{self.path}/done/{self.run + 1}")
        self.run += 1
        return changed

    def read(self) -> DataFrame:
        """Cells of the days that the last run has."""
        bands = ", ".join(f"{c} double" for c in self.bands)
        rows = self.spark.read.schema(f"row int, col int, {bands}, day date").parquet(f"{self.path}/layer")
        return rows.join(self.done().select("day"), "day", "left_semi").select("day", "row", "col", *self.bands)
