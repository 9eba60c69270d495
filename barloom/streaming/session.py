"""Streams of market data: a crossover's fills as they come, lag, late rows, gaps, bars from ticks, and stops.

A stateful operator's whole memory is the state of its key; the checkpoint restores it after a restart. Rows that are older than the state's clock are not
dropped silently but reported as ``late``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.bars import priced

FILL_SCHEMA = "instrument string, kind string, ts long, side int, qty long, price long"


class CrossoverProcessor(StatefulProcessor):
    """For each instrument the fills of a crossover of two averages over bars as they come: what a bar decides fills at the next bar's open."""

    def __init__(self, fast: int, slow: int, qty: int):
        self.fast, self.slow, self.qty = fast, slow, qty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "closes array<long>, target long, position long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closes, target, position, last = ([], 0, 0, -(2**62)) if not self.state.exists() else self.state.get()
        closes, out = list(closes), []
        for frame in rows:
            for r in frame.sort_values("close_ts", kind="stable").itertuples(index=False):
                if r.open_ts < last:
                    out.append((key[0], "late", r.close_ts, None, None, None))
                    continue
                if delta := target - position:
                    out.append((key[0], "fill", r.close_ts, 1 if delta > 0 else -1, abs(delta), r.open))
                    position = target
                last, closes = r.close_ts, [*closes, r.close][-self.slow :]
                if len(closes) == self.slow:
                    gap = sum(closes[-self.fast :]) * self.slow - sum(closes) * self.fast
                    target = self.qty if gap > 0 else -self.qty if gap < 0 else target
        self.state.update(([int(c) for c in closes], int(target), int(position), int(last)))
        made = pd.DataFrame(out, columns=["instrument", "kind", "ts", "side", "qty", "price"])
        yield made.astype({"ts": "Int64", "side": "Int32", "qty": "Int64", "price": "Int64"})

    def close(self) -> None: ...


def crossover_fills(bars: DataFrame, fast: int, slow: int, qty: int) -> DataFrame:
    """Fills (FILL_SCHEMA; kind fill, or late for bars older than what has been seen) of a stream of bars."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return bars.groupBy("instrument").transformWithStateInPandas(CrossoverProcessor(fast, slow, qty), FILL_SCHEMA, "Append", "None")


def gaps(events: DataFrame, ts: str, most: int) -> DataFrame:
    """instrument, gap_from, gap_to: times of more than ``most`` microseconds without an event, as a feed that was cut leaves them."""
    before = F.lag(ts).over(Window.partitionBy("instrument").orderBy(ts))
    return events.select("instrument", before.alias("gap_from"), F.col(ts).alias("gap_to")).where(F.col("gap_to") - F.col("gap_from") > most)


def lag(events: DataFrame, ts: str, arrived: str) -> DataFrame:
    """instrument, n, least, most and last lag between an event and its arrival; lags below zero are kept."""
    gap = F.col(arrived) - F.col(ts)
    return events.groupBy("instrument").agg(F.count("*").alias("n"), F.min(gap).alias("least"), F.max(gap).alias("most"), F.max_by(gap, F.struct(arrived, ts)).alias("last"))


def late(events: DataFrame, ts: str, arrival: str) -> DataFrame:
    """Rows that arrive after a row of their instrument with a later time."""
    newest = F.max(ts).over(Window.partitionBy("instrument").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("newest", newest).where(F.col(ts) < F.col("newest"))


def bars_of_stream(ticks: DataFrame, window: str, lateness: str) -> DataFrame:
    """Bars of closed windows from a stream of ticks (instrument, at, price, size, seq): each is emitted once, when the watermark passes it."""
    order = priced("at")
    return (
        ticks.withWatermark("at", lateness)
        .groupBy("instrument", F.window("at", window).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
        .select("instrument", F.unix_micros("w.start").alias("open_ts"), F.unix_micros("w.end").alias("close_ts"), "open", "high", "low", "close", "volume")
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is available into Parquet under path, and reads it."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_until(stream: DataFrame, path: str, checkpoint: str, seconds: float | None = None, most_rows: int | None = None, wait: float = 0.5) -> DataFrame:
    """Runs a stream into Parquet until so many seconds have passed or so many rows have come, or until it is interrupted; then it stops in order."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="0 seconds").start()
    began, rows, seen = time.monotonic(), 0, -1
    try:
        while not query.awaitTermination(wait):
            for p in query.recentProgress:
                if p["batchId"] > seen:
                    seen, rows = p["batchId"], rows + p["numInputRows"]
            if seconds is not None and time.monotonic() - began >= seconds or most_rows is not None and rows >= most_rows:
                break
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_fills(spark: SparkSession, path: str):
    """For foreachBatch: fills once, however often a batch is repeated: each batch has a folder of its own, which a repetition replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("kind = 'fill'").dropDuplicates(["instrument", "ts"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
