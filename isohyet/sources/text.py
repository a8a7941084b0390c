"""Scans of text sources: lists, tables, inventories, listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.qc import first_present
from ..shared import shared_dir, shuffled


#: Blocks of more files than this are joined without a broadcast.
MANY = 100_000


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, value): lines of each file, numbered from 0, in as many tasks as there are blocks.

    A task numbers the lines of its block; how many lines stand before the block is
    added from a count of the lines of each block.  Fails if the blocks of the two scans
    differ, as they do when their size is changed in between.
    """
    shared_dir(spark)
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    first = read.groupBy("file", "block").agg(F.count("*").alias("n"))
    first = first.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).checkpoint()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            for own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last, at = own, at + 1 if own == last else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["value", "file", "block", "i"])

    own = read.mapInArrow(number, "value string, file string, block long, i long")
    small = first.count() <= MANY
    met = own.join(F.broadcast(first) if small else first, ["file", "block"], "left")
    known = F.when(F.col("first").isNull(), F.raise_error(F.lit("the blocks of a file changed between two scans"))).otherwise(F.col("first"))
    return met.select("file", (F.col("i") + known).alias("at"), "value")


def fixed_ids(spark: SparkSession, path: str | list[str], skip: int, start: int = 0, size: int = 8) -> DataFrame:
    """Distinct ids in columns [start, start + size) after ``skip`` header lines of each file."""
    fid = F.trim(F.regexp_replace(F.substring("value", start + 1, size), "'", ""))
    return lines(spark, path).where(F.col("at") >= skip).select(fid.alias("fid")).where("fid <> ''").distinct()


def profile_files(profiles: list[str], known: dict[str, list[str]]) -> list[str]:
    """List files of named profiles, in order and once; raises for a name that is not known."""
    out: list[str] = []
    for p in profiles:
        name = p.strip().lower()
        if name not in known:
            raise ValueError(f"unknown profile {p!r}; known: {', '.join(sorted(known))}")
        out += [f for f in known[name] if f not in out]
    return out


#: Buoy columns and their names here, and what stands for a missing value.
BUOY = {"WDIR": "wdir", "WSPD": "wind", "GST": "gust", "WVHT": "wave", "DPD": "dominant", "APD": "average", "MWD": "wave_dir",
        "PRES": "pressure", "ATMP": "temperature", "WTMP": "water", "DEWP": "dewpoint", "VIS": "visibility", "TIDE": "tide"}
MISSING = (99.0, 999.0, 9999.0)


#: What stands for a missing value in each column.
OWN_MISSING = {"WDIR": 999.0, "MWD": 999.0, "PRES": 9999.0, "ATMP": 999.0, "WTMP": 999.0, "DEWP": 999.0}


def buoy(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, legacy: bool = True) -> DataFrame:
    """Whitespace text with YY MM DD hh mm first; sentinels are null; the first row of a time stays.

    Without ``columns`` the names come from each file's first line where that is no
    number, else they are all of ``BUOY`` in order; years of two digits are of 1900, and
    minutes may be missing.  ``legacy`` takes 99, 999 and 9999 for missing in every
    column, also a wind direction of 99 degrees; else each column has its own sentinel.
    """
    rows = lines(spark, path).withColumn("p", F.split(F.trim("value"), r"\s+"))
    data = rows.where(F.trim("value").rlike(r"^\d"))
    if columns is not None:
        data = data.withColumn("names", F.array(*map(F.lit, ["YY", "MM", "DD", "hh", "mm", *columns])))
    else:
        head = rows.where((F.col("at") == 0) & F.trim("value").rlike(r"^[^\d\s]")).select("file", F.split(F.regexp_replace(F.trim("value"), r"^#\s*", ""), r"\s+").alias("names"))
        default = F.array(*map(F.lit, ["YY", "MM", "DD", "hh", "mm", *BUOY]))
        data = data.join(head, "file", "left").withColumn("names", F.coalesce("names", default))

    def part(*names: str) -> Column:
        return F.coalesce(*[F.get("p", (F.array_position("names", n) - 1).cast("int")) for n in names])

    year = part("YY", "YYYY").try_cast("int")
    numbers = [part(n).try_cast("int") for n in ("MM", "DD", "hh")] + [F.coalesce(part("mm").try_cast("int"), F.lit(0)), F.lit(0)]
    stamp = F.try_make_timestamp(F.when(year < 100, year + 1900).otherwise(year), *numbers)
    out = data.select("file", "at", stamp.alias("ts"), *[_number(part(c), c, legacy).alias(BUOY.get(c, c)) for c in (BUOY if columns is None else columns)])
    w = Window.partitionBy("file", "ts").orderBy("at")
    return out.where("ts IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "at")


def _number(text: Column, column: str, legacy: bool) -> Column:
    x = text.try_cast("double")
    return F.when(~x.isin(*MISSING) if legacy else x != OWN_MISSING.get(column, 99.0), x)


def byte_ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Inventory lines msg:offset:date:var:level:forecast with the range of each message.

    Lines are dealt by ranges of file and message and written to the checkpoint folder, so
    that no task holds a file; the last message of a range ends before the first one of
    the file's next range.
    """
    shared_dir(spark)
    p = F.split("value", ":")
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = read.where(F.size(p) >= 6).select(
        "file", F.get(p, F.lit(0)).cast("int").alias("msg"), F.get(p, F.lit(1)).cast("long").alias("first"), F.get(p, F.lit(3)).alias("var"), F.get(p, F.lit(4)).alias("level")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, "file", "msg").withColumn("_part", F.spark_partition_id()).checkpoint()
    heads = rows.groupBy("file", "_part").agg(F.min(F.struct("msg", "first")).alias("_head"))  # a row a range and file
    heads = heads.withColumn("_next", F.lead("_head").over(Window.partitionBy("file").orderBy("_part"))).drop("_head")
    w = Window.partitionBy("file", "_part").orderBy("msg", "first")
    out = rows.repartition(tasks, "file", "_part").withColumn("last", F.lead(F.struct("msg", "first")).over(w)).join(shuffled(heads), ["file", "_part"])
    return out.withColumn("last", F.coalesce(F.coalesce("last", "_next")["first"] - 1, F.lit(-1))).drop("_part", "_next")


def name_facts(df: DataFrame, column: str = "file") -> DataFrame:
    """day, hour and channel from file names with yyyymmdd, tHHz or CNN parts."""
    name = F.element_at(F.split(F.col(column), "/"), -1)
    day = F.try_to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd")
    return df.withColumns({"day": day, "hour": F.regexp_extract(name, r"t(\d{2})z", 1).try_cast("int"), "channel": F.nullif(F.regexp_extract(name, r"(C\d{2})", 1), F.lit(""))})


#: Candidate names of inventory columns.
NAMES = {"fid": ("station_id", "fid", "id", "stationid"), "lat": ("latitude", "lat", "y"), "lon": ("longitude", "lon", "lng", "x"), "elev": ("elevation", "elev", "z")}


def inventory(df: DataFrame) -> DataFrame:
    """(fid, lat, lon, elev) of a station list whatever its column names; the first row of an id stays."""
    found = {k: first_present(df, names) for k, names in NAMES.items()}
    if not all(found[k] for k in ("fid", "lat", "lon")):
        raise ValueError(f"no id or coordinates among {df.columns}")
    cast = lambda k: (F.col(found[k]).try_cast("double") if found[k] else F.lit(None).cast("double")).alias(k)
    return df.select(F.col(found["fid"]).cast("string").alias("fid"), cast("lat"), cast("lon"), cast("elev")).dropna(subset=["fid", "lat", "lon"]).dropDuplicates(["fid"])


def wide_bands(df: DataFrame, key: str, year: str, starts: dict[int, str]) -> DataFrame:
    """Columns ``band_period`` as rows (key, day, band, value); day is the period's first (MM-dd)."""
    names = [c for c in df.columns if "_" in c and c.rsplit("_", 1)[1].isdigit()]
    cells = F.explode(F.array(*[F.struct(F.lit(c.rsplit("_", 1)[0]).alias("band"), F.lit(starts[int(c.rsplit("_", 1)[1])]).alias("at"), F.col(c).cast("double").alias("value")) for c in names]))
    out = df.select(key, F.col(year).alias("y"), cells.alias("c"))
    return out.select(key, F.to_date(F.concat_ws("-", F.col("y").cast("string"), "c.at")).alias("day"), "c.band", "c.value")


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def water_years(df: DataFrame, key: str, value: str, unit: str | None = None, cumulative: bool = False, reset: bool = True) -> DataFrame:
    """(key, day, value) of rows (key, wy, d, Jan .. Dec): a row for each day of the month of a water year.

    Months from October on are of the year before.  ``unit``: ``inch`` to millimetres or
    ``fahrenheit`` to degrees Celsius.  A cumulative series becomes daily amounts, each
    less that of the row before; with ``reset`` the count starts anew with the water
    year, so its first row is its own amount, else that row is less the last year's and
    only the first of all is null.  Days that no calendar has, and nulls, drop out.
    """
    months = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("m"), F.col(n).cast("double").alias("x")) for i, n in enumerate(MONTHS)]))
    rows = df.select(key, F.col("wy").cast("int").alias("wy"), F.col("d").cast("int").alias("d"), months.alias("c"))
    year = F.when(F.col("c.m") >= 10, F.col("wy") - 1).otherwise(F.col("wy"))
    real = F.col("d") <= F.dayofmonth(F.last_day(F.make_date(year, F.col("c.m"), F.lit(1))))
    x = {None: F.col("c.x"), "inch": F.col("c.x") * 25.4, "fahrenheit": (F.col("c.x") - 32) * 5 / 9}[unit]
    out = rows.where((F.col("d") >= 1) & real & F.col("c.x").isNotNull()).select(key, "wy", F.make_date(year, "c.m", "d").alias("day"), x.alias(value))
    if not cumulative:
        return out.drop("wy")
    w = Window.partitionBy(key, "wy").orderBy("day") if reset else Window.partitionBy(key).orderBy("day")
    before = F.lag(value).over(w)
    return out.withColumn(value, F.col(value) - (F.coalesce(before, F.lit(0.0)) if reset else before)).drop("wy")


def station_attributes(spark: SparkSession, files: list[str], key: str, columns: list[str], places: tuple[str, str]) -> DataFrame:
    """(key, latitude, longitude, columns) of station records in tile files of the same header.

    ``places`` names the files' latitude and longitude.  Of a station's records that of
    the first file by name stays (ties: the smallest row); what is no number is null.
    """
    read = spark.read.csv(files, header=True, enforceSchema=False).withColumn("_file", F.col("_metadata.file_path"))
    out = read.select(
        F.col(key), *[F.col(p).try_cast("double").alias(n) for p, n in zip(places, ("latitude", "longitude"), strict=True)],
        *[F.col(c).try_cast("double").alias(c) for c in columns], "_file",
    )
    own = F.struct(*[c for c in out.columns if c != "_file"])
    return out.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(own, F.struct(F.col("_file"), own)).alias("r")).select("r.*")


def drifting_csv(spark: SparkSession, paths: list[str], drop: tuple[str, ...] = (".geo", "system:index")) -> DataFrame:
    """Yearly files of differing columns as one table; ``year`` from the name, all-null rows dropped."""
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True, inferSchema=True)
        df = df.drop(*[f"`{c}`" if "." in c else c for c in drop if c in df.columns and "." not in c]).select(*[F.col(f"`{c}`") for c in df.columns if c not in drop])
        df = df.dropna(how="all").withColumn("year", F.regexp_extract(F.input_file_name(), r"(\d{4})\D*$", 1).try_cast("int"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def complete_months(df: DataFrame, key: str, ts: str, months: int, most_missing: int, step: str) -> DataFrame:
    """Rows of the keys that have all months and lack at most so many steps of their span."""
    span = F.size(F.sequence(F.min(ts), F.max(ts), F.expr(step)))
    facts = df.groupBy(key).agg(F.count_distinct(F.date_trunc("month", ts)).alias("m"), (span - F.count_distinct(ts)).alias("gap"))
    good = facts.where((F.col("m") >= months) & (F.col("gap") <= most_missing)).select(key)
    return df.join(good, key, "left_semi").dropDuplicates([key, ts])
