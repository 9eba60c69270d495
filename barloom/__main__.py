"""Command line: ``python -m barloom run|report|convert|fetch``.

run      runs a strategy over a tape or a delimited file, stores its events and prints its figures; each instrument is a run
report   prints, or writes as JSON or HTML, the figures of a stored run
convert  turns the bars of one instrument in a delimited file into a tape
fetch    reads bars from a venue into a store
"""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import report, runs
from barloom.operators.instruments import PRESETS, Instrument, load
from barloom.operators.strategies import STRATEGIES
from barloom.session import session
from barloom.sources import files, venues


def _bars(spark: SparkSession, a: argparse.Namespace, own: Instrument) -> DataFrame:
    if a.source.endswith(".tape"):
        return files.read_tape(spark, a.source).drop("timeframe")
    return files.read_csv(spark, a.source, own.symbol, times.parse_timeframe(a.timeframe), own.price_exp, own.qty_exp, unit=a.unit).drop("timeframe")


def _shown(events: DataFrame, run_id: str, a: argparse.Namespace) -> None:
    s = report.summary(events, run_id)
    if a.json:
        Path(a.json).write_text(report.to_json(s))
    if a.html:
        Path(a.html).write_text(report.to_html(events, run_id))
    print(report.to_text(s), end="")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    own = load(a.instrument)
    bars = _bars(spark, a, own).persist()
    params = json.loads(a.params) | ({"flatten": True} if a.flatten else {})
    several = bars.select("instrument").distinct().limit(2).count() > 1
    name = F.concat(F.lit(a.run_id + "/"), "instrument") if several else F.lit(a.run_id)
    events = runs.run(bars, a.strategy, own, PRESETS[a.preset], name, int(a.cash * 10**8), **params).persist()
    store = files.Store(spark, a.store) if a.store else files.NullStore()
    store.save_run(events, int(time.time() * 1_000_000))
    for r in events.select("run_id").distinct().orderBy("run_id").toLocalIterator():
        _shown(events, r.run_id, a)


def fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    own = load(a.instrument)
    spark.dataSource.register(venues.VenueSource)
    options = {"venue": a.venue, "base": a.base, "symbol": own.symbol, "timeframe": a.timeframe, "since": a.since, "until": a.until} | ({"fetch": a.fetch} if a.fetch else {})
    bars = venues.scaled(spark.read.format("venue").options(**options).load(), own.price_exp, own.qty_exp)
    store = files.Store(spark, a.store)
    store.put_bars(bars.withColumn("timeframe", F.lit(times.parse_timeframe(a.timeframe))))
    n = store.coverage().where(F.col("instrument") == own.symbol).agg(F.sum("bar_count")).first()[0]
    print(f"{n or 0} bars")


def show(spark: SparkSession, a: argparse.Namespace) -> None:
    _shown(files.Store(spark, a.store).run(a.run_id).persist(), a.run_id, a)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    own = load(a.instrument)
    frame = _bars(spark, a, own).orderBy("open_ts").toPandas()
    Path(a.to).write_bytes(files.bars_to_tape(frame, {"symbol": own.symbol, "priceExp": own.price_exp, "qtyExp": own.qty_exp}, times.parse_timeframe(a.timeframe)))
    print(f"{len(frame)} bars")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("barloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    for name, f in (("run", run), ("report", show), ("convert", convert), ("fetch", fetch)):
        c = sub.add_parser(name)
        c.set_defaults(run=f)
        if name == "fetch":
            c.add_argument("--venue", default="klines", choices=("klines", "candles"))
            c.add_argument("--base", required=True)
            c.add_argument("--since", required=True)
            c.add_argument("--until", required=True)
            c.add_argument("--fetch")
        if name in ("run", "convert"):
            c.add_argument("source")
        if name != "report":
            c.add_argument("--instrument", default="BTCUSDT")
            c.add_argument("--timeframe", default="1h")
            c.add_argument("--unit", default="iso", choices=("iso", "ms", "s", "us"))
        if name == "run":
            c.add_argument("--strategy", default="sma-crossover", choices=sorted(STRATEGIES))
            c.add_argument("--params", default="{}")
            c.add_argument("--preset", default="ideal", choices=sorted(PRESETS))
            c.add_argument("--cash", type=float, default=100_000)
            c.add_argument("--flatten", action="store_true")
        if name == "convert":
            c.add_argument("--to", required=True)
        else:
            c.add_argument("--store", required=name != "run")
        if name in ("run", "report"):
            c.add_argument("--run-id", default="run")
            c.add_argument("--json")
            c.add_argument("--html")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or session("barloom"), a)


if __name__ == "__main__":
    main()
