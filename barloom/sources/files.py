"""Bars and ticks from and to files: delimited text, and the binary columnar tape."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import fixed, times

#: First bytes and columns of the format (fixed values).
MAGIC = b"TAPEDCK1"
BAR_COLUMNS = ("openTs", "closeTs", "open", "high", "low", "close", "volume")
TICK_COLUMNS = (("ts", "f64"), ("price", "f64"), ("size", "f64"), ("aggressor", "i8"))
BAR_SCHEMA = "instrument string, timeframe long, open_ts long, close_ts long, open long, high long, low long, close long, volume long"
TICK_SCHEMA = "instrument string, ts long, price long, size long, aggressor int"


def _time(c, unit: str):
    return {"iso": times.from_iso, "ms": lambda x: x.cast("long") * 1_000, "s": lambda x: x.cast("long") * 1_000_000, "us": lambda x: x.cast("long")}[unit](c)


def read_csv(
    spark: SparkSession, path: str, instrument: str, timeframe: int, price_exp: int, qty_exp: int, columns: dict[str, str] | None = None, unit: str = "iso", stamp: str = "open", sep: str = ",", since: int | None = None, until: int | None = None
) -> DataFrame:
    """Bars of a delimited file with a header. Names ignore case and may be mapped; prices are read as text, so they are exact.

    ``stamp`` says whether the time is a bar's open or close. Bars that do not lie within [since, until] are left out.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    names = {c.lower().strip(): c for c in raw.columns}
    wanted = {"timestamp": "timestamp", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"} | {k: v.lower() for k, v in (columns or {}).items()}
    missing = [v for v in wanted.values() if v not in names]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    c = lambda k: F.col(f"`{names[wanted[k]]}`")
    at = _time(c("timestamp"), unit)
    opens = at if stamp == "open" else at - timeframe
    closes = _time(c("close_ts"), unit) if "close_ts" in wanted else opens + timeframe
    out = raw.select(
        F.lit(instrument).alias("instrument"), F.lit(timeframe).cast("long").alias("timeframe"), opens.alias("open_ts"), closes.alias("close_ts"), *(fixed.parse_fixed(c(p), price_exp).alias(p) for p in ("open", "high", "low", "close")), fixed.parse_fixed(c("volume"), qty_exp).alias("volume")
    )
    if since is not None:
        out = out.where(F.col("open_ts") >= since)
    return out.where(F.col("close_ts") <= until) if until is not None else out


def encode_tape(header: dict, columns: list[np.ndarray]) -> bytes:
    """A tape: magic, length of the header, header as JSON, then each column from a multiple of eight on."""
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    head = json.dumps(header).encode()
    out = pad(MAGIC + struct.pack("<I", len(head)) + head)
    for c in columns:
        out += pad(c.tobytes())
    return out


def decode_tape(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    if data[:8] != MAGIC or len(data) < 12:
        raise ValueError("not a tape")
    (n,) = struct.unpack_from("<I", data, 8)
    try:
        header = json.loads(data[12 : 12 + n])
    except ValueError:
        raise ValueError("the tape's header cannot be read") from None
    at, out = 12 + n, {}
    for column in header["columns"]:
        at += -at % 8
        kind = {"f64": "<f8", "i8": "i1"}[column["dtype"]]
        size = header["count"] * np.dtype(kind).itemsize
        if at + size > len(data):
            raise ValueError(f"the tape is cut short within {column['name']}")
        out[column["name"]] = np.frombuffer(data, kind, header["count"], at)
        at += size
    return header, out


def _bars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["content"]:
            header, c = decode_tape(bytes(data))
            if header["kind"] != "bars":
                raise ValueError(f"a tape of bars is expected, not of {header['kind']}")
            frame = pd.DataFrame({k: c[n].astype(np.int64) for k, n in zip(("open_ts", "close_ts", "open", "high", "low", "close", "volume"), BAR_COLUMNS, strict=True)})
            frame.insert(0, "instrument", header["instrument"]["symbol"]), frame.insert(1, "timeframe", int(header.get("timeframe") or 0))
            for i in range(0, len(frame), 100_000):
                yield frame.iloc[i : i + 100_000]


def _ticks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["content"]:
            header, c = decode_tape(bytes(data))
            if header["kind"] != "ticks":
                raise ValueError(f"a tape of ticks is expected, not of {header['kind']}")
            frame = pd.DataFrame({k: c[k].astype(np.int64) for k in ("ts", "price", "size")} | {"aggressor": c["aggressor"].astype(np.int32)})
            frame.insert(0, "instrument", header["instrument"]["symbol"])
            for i in range(0, len(frame), 100_000):
                yield frame.iloc[i : i + 100_000]


def read_tape(spark: SparkSession, path: str, kind: str = "bars") -> DataFrame:
    """All tapes under path; each file is decoded by one task."""
    run, schema = (_bars, BAR_SCHEMA) if kind == "bars" else (_ticks, TICK_SCHEMA)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def bars_to_tape(frame: pd.DataFrame, instrument: dict, timeframe: int, source: str = "barloom") -> bytes:
    """The bars of one instrument, in order, as a tape."""
    header = {"version": 1, "kind": "bars", "count": len(frame), "timeframe": timeframe, "instrument": instrument, "source": source, "columns": [{"name": n, "dtype": "f64"} for n in BAR_COLUMNS]}
    return encode_tape(header, [frame[c].to_numpy().astype("<f8") for c in ("open_ts", "close_ts", "open", "high", "low", "close", "volume")])


def ticks_to_tape(frame: pd.DataFrame, instrument: dict, source: str = "barloom") -> bytes:
    header = {"version": 1, "kind": "ticks", "count": len(frame), "instrument": instrument, "source": source, "columns": [{"name": n, "dtype": d} for n, d in TICK_COLUMNS]}
    return encode_tape(header, [frame[n].to_numpy().astype("<f8" if d == "f64" else "i1") for n, d in TICK_COLUMNS])


#: A tape holds at most so many microseconds of an instrument, so that a task makes or reads one whole.
TAPE_SPAN = 400 * times.DAY


def write_tapes(rows: DataFrame, path: str, timeframe: int, price_exp: int, qty_exp: int, kind: str = "bars", span: int = TAPE_SPAN) -> None:
    """Bars (or ticks: instrument, ts, price, size, aggressor) as tapes under path, one for each instrument and span of time. Spark's committer writes them, so a lost
    executor leaves no half tape."""
    at = "open_ts" if kind == "bars" else "ts"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        about = {"symbol": str(frame["instrument"].iloc[0]), "priceExp": price_exp, "qtyExp": qty_exp}
        frame = frame.sort_values(at, kind="stable")
        return pd.DataFrame({"tape": [bars_to_tape(frame, about, timeframe) if kind == "bars" else ticks_to_tape(frame, about)]})

    run.__annotations__.clear()
    cut = rows.withColumn("_span", F.floor(F.col(at) / span))
    tapes = cut.groupBy("instrument", "_span").applyInPandas(run, "tape binary").select(F.col("tape").cast("string").alias("value"))
    # A row is a file; readers know a tape's length from its header, so the line's end behind it does no harm.
    tapes.write.option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


class Store:
    """Bars, runs and fills as Parquet under a path that Spark reaches: bars by instrument and timeframe, runs by id; rewriting a partition replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put_bars(self, bars: DataFrame) -> None:
        bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "timeframe").parquet(f"{self.path}/bars")

    def bars(self, instrument: str, timeframe: int, since: int, until: int) -> DataFrame:
        """Read back by partition and by range, both pushed down to the files."""
        return self.spark.read.parquet(f"{self.path}/bars").where((F.col("instrument") == instrument) & (F.col("timeframe") == timeframe) & (F.col("open_ts") >= since) & (F.col("close_ts") <= until))

    def coverage(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bars").groupBy("instrument", "timeframe").agg(F.min("open_ts").alias("from_ts"), F.max("close_ts").alias("to_ts"), F.count("*").alias("bar_count"))

    def covering(self, instrument: str, timeframe: int, since: int, until: int) -> DataFrame:
        """The smallest stored range that covers the query."""
        fits = (F.col("instrument") == instrument) & (F.col("timeframe") == timeframe) & (F.col("from_ts") <= since) & (F.col("to_ts") >= until)
        return self.coverage().where(fits).orderBy("bar_count").limit(1)

    def save_run(self, events: DataFrame, created_at: int) -> None:
        events.withColumn("created_at", F.lit(created_at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.path}/runs")

    def run(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs").where(F.col("run_id") == run_id)

    def runs(self, most: int = 50) -> DataFrame:
        """The newest runs first."""
        rows = self.spark.read.parquet(f"{self.path}/runs").groupBy("run_id").agg(F.max("created_at").alias("created_at"))
        return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(most)


class NullStore:
    """Takes what a store takes and keeps nothing: for runs that are only reported."""

    def put_bars(self, bars: DataFrame) -> None: ...

    def save_run(self, events: DataFrame, created_at: int) -> None: ...
