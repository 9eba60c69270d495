"""Market data from general tables: ticks from an event stream, daily prices from shipments, fills from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, ts_us, price, size, aggressor, seq: an event is a print, its type the instrument."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        times.micros(F.col("ts")).alias("ts_us"),
        cents("value").alias("price"),
        (F.col("event_id") % 100 + 1).alias("size"),
        ((F.col("event_id") % 3).cast("int") - 1).alias("aggressor"),
        F.col("event_id").alias("seq"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an hour from the ticks."""
    return bars.from_ticks(ticks(spark, sf_dir), times.HOUR)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, instrument, ts_us, seq, side (1 buy, -1 sell), qty, price: an order is a fill, its priority the instrument."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("instrument"),
        times.micros(F.col("o_orderdate")).alias("ts_us"),
        F.col("o_orderkey").alias("seq"),
        (1 - 2 * (F.col("o_orderkey") % 2)).alias("side"),
        (F.col("o_custkey") % 20 + 1).alias("qty"),
        cents("o_totalprice").alias("price"),
    )
