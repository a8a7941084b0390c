"""Streams: daily aggregates, runs, windows, rejection monitor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_stream(events: DataFrame, value: str = "value", late: str = "6 hours", least: int = 1) -> DataFrame:
    """Daily mean, extremes and count of each station; rows later than ``late`` are dropped."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "fid")
    out = days.agg(F.avg(value).alias("mean"), F.max(value).alias("top"), F.min(value).alias("low"), F.count(value).alias("n"))
    return out.where(F.col("n") >= least).select("fid", F.to_date("window.start").alias("day"), "mean", "top", "low", "n")


def sliding_stream(events: DataFrame, days: int, stride: int, least: int, late: str = "1 day") -> DataFrame:
    """Windows of so many days, each stride, with at least so many rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", f"{stride} days"), "fid")
    return w.agg(F.count("*").alias("n")).where(F.col("n") >= least).select("fid", F.col("window.start").alias("start"), "n")


def run_stream(days: DataFrame, late: str = "1 day") -> DataFrame:
    """Runs of consecutive days as sessions with a gap of a day and a second."""
    w = days.withWatermark("ts", late).groupBy(F.session_window("ts", "1 day 1 second"), "fid")
    return w.agg(F.count("*").alias("n")).select("fid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _changes(keys: np.ndarray) -> np.ndarray:
    """Whether a column differs from the one before; the first one does."""
    return np.concatenate([np.ones(min(1, keys.shape[1]), bool), (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def rejection_stream(rows: DataFrame, days: int = 90, limit: float = 0.5, late: str = "7 days", shards: int = 256) -> DataFrame:
    """(fid, day, n, bad, rate, listed): the rate of rejected rows over the trailing days, once for each day that is closed.

    rows: fid (long), day (date), n, bad (counts, null for none), in any order and any number a day.
    They are kept as state by station and day, in so many ``shards`` of stations, each of
    which is brought up to date at once.  A day closes when the watermark passes it, which a
    timer tells where no row comes; then its row goes out, and days that no open day can
    reach leave the state.  Rows of closed days are dropped as late.
    """
    day_ms = 86_400_000
    names = ["known", "fid", "number", "n", "bad"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held = state.get if state.exists else (0, b"")
        parts = [np.frombuffer(held, np.int64).reshape(5, -1)] + [p[names].to_numpy(np.int64).T for p in batches]
        every = np.concatenate(parts, axis=1)
        every = every[:, np.lexsort(every[2::-1])]  # by station and day
        starts = np.flatnonzero(_changes(every[:3]))
        held = np.vstack([every[:3, starts], np.add.reduceat(every[3:], starts, axis=1) if len(starts) else every[3:]])
        mark, number = state.getCurrentWatermarkMs(), held[2]
        closed = np.flatnonzero((number >= first) & (number * day_ms < mark))
        if len(closed):
            span = np.ptp(number) + days + 1  # stations lie more than ``days`` apart
            place = _changes(held[:2]).cumsum() * span + number - number.min()
            before = np.searchsorted(place, place[closed] - days, side="right")
            total = np.pad(held[3:], ((0, 0), (1, 0))).cumsum(axis=1)
            n, bad = total[:, closed + 1] - total[:, before]
            rate = pd.Series(bad / np.where(n == 0, 1, n)).where(n != 0)
            out = pd.DataFrame(dict(zip(names, held[:, closed], strict=True)))
            yield out.assign(rate=rate, listed=(rate > limit).astype("boolean").where(rate.notna()))
        first = max(first, -(-mark // day_ms))  # the first day that is open
        held = held[:, number > first - days]
        if held.size:
            state.update((first, held.tobytes()))
            waiting = held[2][held[2] >= first]
            after = waiting.min() if len(waiting) else held[2].max() + days  # no open day reaches the closed ones any more
            state.setTimeoutTimestamp(max(int(after) * day_ms, mark) + 1)
        elif state.exists:
            state.remove()

    known = F.col("fid").isNotNull().cast("long").alias("known")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n", "bad")]
    kept = rows.select(known, F.coalesce("fid", F.lit(0)).cast("long").alias("fid"), F.unix_date("day").cast("long").alias("number"), *counts, F.to_timestamp("day").alias("ts"))
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("known", "fid"), F.lit(shards)))
    out = kept.withWatermark("ts", late).groupBy("shard").applyInPandasWithState(
        update, "known long, fid long, number long, n long, bad long, rate double, listed boolean",
        "first long, held binary", "append", GroupStateTimeout.EventTimeTimeout,
    )
    fid = F.when(F.col("known") == 1, F.col("fid")).alias("fid")
    return out.select(fid, F.date_from_unix_date(F.col("number").cast("int")).alias("day"), "n", "bad", "rate", "listed")
