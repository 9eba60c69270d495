"""Queries that run streams to their end over the event table's file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.market import BARS, TICKS
from barloom.plans.registry import query
from barloom.plans.trading import _cross, crossover
from barloom.session import shared_folder
from barloom.sources import adapters
from barloom.streaming import session


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = adapters.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("at"), adapters.cents("value").alias("price"), (F.col("event_id") % 100 + 1).alias("size"), F.col("event_id").alias("seq"))


@query(f"WITH {BARS} SELECT instrument, open_ts, close_ts, open, high, low, close, volume FROM bars WHERE close_ts <= (SELECT max(ts_us) FROM ticks)")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of a stream whose windows have closed when the last tick has come."""
    at = shared_folder(spark, "stream")
    out = session.run_to_end(session.bars_of_stream(_stream(spark, d), "1 hour", "0 seconds"), f"{at}/out", f"{at}/state")
    return out.where(F.col("close_ts") <= F.lit(adapters.ticks(spark, d).agg(F.max("ts_us")).first()[0]))


_ARRIVED = f"{TICKS}, a AS (SELECT instrument, ts_us, seq, ts_us + (seq * 7919) % 5000000 - 1000000 AS arrived FROM ticks)"


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return adapters.ticks(spark, d).select("instrument", "ts_us", "seq", (F.col("ts_us") + (F.col("seq") * 7919) % 5_000_000 - 1_000_000).alias("arrived"))


@query(f"WITH {_ARRIVED} SELECT instrument, count(*) AS n, min(arrived - ts_us) AS least, max(arrived - ts_us) AS most, arg_max(arrived - ts_us, (arrived, ts_us)) AS last FROM a GROUP BY 1")
def stream_lag(spark: SparkSession, d: str) -> DataFrame:
    return session.lag(_arrivals(spark, d), "ts_us", "arrived")


@query(f"WITH {TICKS}, a AS (SELECT instrument, ts_us, seq, ts_us + (seq * 791900003) % 3600000000 AS arrived FROM ticks), w AS (SELECT *, max(ts_us) OVER (PARTITION BY instrument ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a) SELECT instrument, seq, ts_us, newest FROM w WHERE ts_us < newest")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.ticks(spark, d).select("instrument", "ts_us", "seq", F.struct((F.col("ts_us") + (F.col("seq") * 791_900_003) % 3_600_000_000).alias("a"), "seq").alias("arrived"))
    return session.late(rows, "ts_us", "arrived").select("instrument", "seq", "ts_us", "newest")


@query(f"WITH {_cross(8, 24, 10, 0, 0)} SELECT instrument, close_ts AS ts, CAST(sign(delta) AS INTEGER) AS side, abs(delta) AS qty, fill_price AS price, true AS equal FROM run WHERE delta <> 0")
def stream_kernel_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The fills of a crossover over a stream of bars, and whether the batch has the same."""
    bars = adapters.hourly(spark, d)
    at = shared_folder(spark, "stream")
    bars.repartition(2, "instrument").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(bars.schema).parquet(f"{at}/in")
    keys = ["instrument", "ts", "side", "qty", "price"]
    live = session.run_to_end(session.crossover_fills(stream, 8, 24, 10), f"{at}/out", f"{at}/state").where("kind = 'fill'").select(*keys, F.lit(True).alias("live"))
    batch = crossover(bars, 8, 24, 10).where("delta <> 0").select("instrument", F.col("close_ts").alias("ts"), F.signum("delta").cast("int").alias("side"), F.abs("delta").alias("qty"), F.col("fill_price").alias("price"), F.lit(True).alias("batch"))
    return live.join(batch, keys, "full").select(*keys, F.coalesce(F.col("live") & F.col("batch"), F.lit(False)).alias("equal"))


@query(f"WITH {TICKS}, g AS (SELECT instrument, lag(ts_us) OVER (PARTITION BY instrument ORDER BY ts_us) AS gap_from, ts_us AS gap_to FROM ticks) SELECT * FROM g WHERE gap_to - gap_from > 900000000")
def feed_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of an hour without a tick."""
    return session.gaps(adapters.ticks(spark, d), "ts_us", 900_000_000)
