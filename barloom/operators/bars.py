"""Bars: from ticks, resampled, validated, with price sources and gaps.

A bar is instrument, open_ts (inclusive), close_ts (exclusive), open, high, low, close, volume. All grouping combines before it
shuffles; windows are keyed by instrument and ordered by close_ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import times

OHLCV = ("open", "high", "low", "close", "volume")
SOURCES = ("open", "high", "low", "close", "hl2", "hlc3", "ohlc4")


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("instrument",))).orderBy("close_ts")


def laid_out(bars: DataFrame, partitions: int) -> DataFrame:
    """bars dealt by instrument and sorted by time, as every window wants them: kept that way (persisted, or written in buckets), windows over them neither shuffle nor sort."""
    return bars.repartition(partitions, "instrument").sortWithinPartitions("instrument", "close_ts")


def priced(ts: str) -> Column:
    """The order of ticks with a price, null for others; of ticks at one time those without a number come last."""
    return F.when(F.col("price").isNotNull(), F.struct(ts, F.isnull("seq"), "seq"))


def from_ticks(ticks: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` microseconds from ticks (instrument, ts_us, price, size, seq); times without a tick have no bar.
    Ticks without a price add their size only."""
    slot = (F.col("ts_us") - F.pmod("ts_us", F.lit(size))).alias("open_ts")
    order = priced("ts_us")
    return (
        ticks.groupBy("instrument", slot)
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
        .select("instrument", "open_ts", (F.col("open_ts") + size).alias("close_ts"), *OHLCV)
    )


def resample(bars: DataFrame, size: int, source_size: int) -> DataFrame:
    """Larger bars with n (source bars in it), bucket_end and dropped (the last bucket of an instrument, if it is not complete).

    A larger bar closes when its last source bar does. Use ``where(~dropped)`` for the bars themselves.
    """
    if size % source_size or size < source_size:
        raise ValueError("the target timeframe must be a whole multiple of the source's")
    start = (F.col("open_ts") - F.pmod("open_ts", F.lit(size))).alias("bucket")
    out = bars.groupBy("instrument", start).agg(
        F.min_by("open", "open_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ts").alias("close"), F.sum("volume").alias("volume"), F.max("close_ts").alias("close_ts"), F.count("*").alias("n")
    )
    last = F.col("bucket") == F.max("bucket").over(Window.partitionBy("instrument"))
    return out.select(
        "instrument", F.col("bucket").alias("open_ts"), "close_ts", *OHLCV, "n", (F.col("bucket") + size).alias("bucket_end"), (last & (F.col("close_ts") < F.col("bucket") + size)).alias("dropped")
    )


def price(source: str) -> Column:
    """A price source of a bar; the averages are doubles."""
    if source in ("open", "high", "low", "close"):
        return F.col(source)
    parts = {"hl2": ("high", "low"), "hlc3": ("high", "low", "close"), "ohlc4": ("open", "high", "low", "close")}[source]
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return total / F.lit(len(parts))


def violations(bars: DataFrame) -> DataFrame:
    """bars with the first rule that each breaks in ``violation``: range, open, close, volume, times, overlap; null if none."""
    previous = F.lag("close_ts").over(by_time())
    rule = (
        F.when(F.greatest(*(F.abs(c) for c in OHLCV)) > 2**53 - 1, "unsafe")
        .when(F.col("high") < F.col("low"), "range")
        .when(~F.col("open").between(F.col("low"), F.col("high")), "open")
        .when(~F.col("close").between(F.col("low"), F.col("high")), "close")
        .when(F.col("volume") < 0, "volume")
        .when(F.col("close_ts") <= F.col("open_ts"), "times")
        .when(F.col("open_ts") < previous, "overlap")
    )
    return bars.withColumn("violation", rule)


def checked(bars: DataFrame) -> DataFrame:
    """bars; the query fails if one breaks a rule."""
    found = violations(bars)
    return found.where(F.when(F.col("violation").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bar breaks rule: "), "violation")).cast("boolean"))).drop("violation")


def gaps(bars: DataFrame) -> DataFrame:
    """Times without bars: instrument, gap_from, gap_to."""
    previous = F.lag("close_ts").over(by_time()).alias("gap_from")
    return bars.select("instrument", previous, F.col("open_ts").alias("gap_to")).where("gap_from < gap_to")


def numbered(bars: DataFrame) -> DataFrame:
    """bars with ``i``: its place within its instrument, from 0 on."""
    return bars.withColumn("i", F.row_number().over(by_time()) - 1)


def day_of(close_ts: str = "close_ts") -> Column:
    """The UTC day that a bar is told on: that of its close."""
    return times.day_index(F.col(close_ts))
