"""Strategies as queries: bars in, fills out, all instruments at once.

A bar decides at its close and its order fills at the next bar's open. Fills are (instrument, ts_us, seq, side, qty, price, commission, slippage, taker, tag); ts_us is
the close of the bar that fills. Strategies that enter only while flat first make a candidate of every signal with the exit it would have, and
then keep those that do not begin within one kept before (``without_overlap``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.errors import ConfigError
from barloom.functions import fixed
from barloom.operators import indicators, matching, orders
from barloom.operators.bars import by_time, numbered
from barloom.operators.instruments import Costs, Instrument

FILL = ("instrument", "ts_us", "seq", "side", "qty", "price", "commission", "slippage", "taker", "tag")


def charged(rows: DataFrame, own: Instrument, costs: Costs) -> DataFrame:
    """Fills from rows (instrument, ts_us, seq, side, qty, reference, taker, tag and the bar's high and low): price, commission and what slippage cost."""
    taker, side = F.col("taker"), F.col("side").cast("int")
    made = rows.withColumn("side", side).withColumn("price", costs.price(own, F.col("reference"), F.col("side"), taker, F.col("high") - F.col("low")))
    made = made.withColumn("_worth", fixed.notional(F.col("price"), F.col("qty"), own.point_value, own.divisor))
    made = made.withColumn("commission", costs.fee(own, F.col("_worth"), F.col("qty"), taker))
    slip = fixed.price_delta_to_money(F.col("price") - F.col("reference"), F.col("side") * F.col("qty"), own.point_value, own.divisor)
    return made.withColumn("slippage", slip).select(*FILL)


def crossover(bars: DataFrame, own: Instrument, costs: Costs, fast: int = 24, slow: int = 72, qty: int = 1, short: bool = True, flatten: bool = False) -> DataFrame:
    """Long while the fast mean is above the slow one, short (or flat) below."""
    if fast >= slow or qty <= 0:
        raise ConfigError("fast must be below slow, and qty positive")
    w = by_time()
    rows = orders.crossover_targets(bars, fast, slow, qty, short).withColumn("_n", F.row_number().over(w))
    before = F.coalesce(F.lag("target").over(w), F.lit(0))
    rows = rows.withColumn("_held", before).withColumn("_delta", before - F.coalesce(F.lag("target", 2).over(w), F.lit(0)))
    tag = F.when(F.col("_held") > 0, "long").when(F.col("_held") < 0, "short").otherwise("exit")
    bar = ("high", "low")
    fills = rows.where("_delta <> 0").select("instrument", F.col("close_ts").alias("ts_us"), (2 * F.col("_n")).alias("seq"), F.signum("_delta").alias("side"), F.abs("_delta").alias("qty"), F.col("open").alias("reference"), F.lit(True).alias("taker"), tag.alias("tag"), *bar)
    if flatten:
        last = rows.groupBy("instrument").agg(F.max_by(F.struct("close_ts", "_n", "_held", "close", "high", "low"), "close_ts").alias("x")).where("x._held <> 0")
        end = last.select("instrument", F.col("x.close_ts").alias("ts_us"), (2 * F.col("x._n") + 1).alias("seq"), (-F.signum("x._held")).alias("side"), F.abs("x._held").alias("qty"), F.col("x.close").alias("reference"), F.lit(True).alias("taker"), F.lit("end-of-run-flatten").alias("tag"), *(F.col(f"x.{c}") for c in bar))
        closing = charged(end, own, Costs(("none", 0), costs.commission))
        return charged(fills, own, costs).unionByName(closing)
    return charged(fills, own, costs)


def without_overlap(candidates: DataFrame) -> DataFrame:
    """Of candidates (instrument, i, exit_i and more) those that begin at or after the exit of the last one kept, from each instrument's first on; a null exit never ends.

    Candidates are dealt by instrument and sorted; a worker reads them in batches and carries nothing but the last exit.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, free = None, 0
        for frame in frames:
            keep = []
            for name, i, end in zip(frame["instrument"].tolist(), frame["i"].tolist(), frame["exit_i"].tolist(), strict=True):
                if name != own:
                    own, free = name, -1
                keep.append(i >= free)
                if keep[-1]:
                    free = float("inf") if pd.isna(end) else end
            yield frame[keep]

    return candidates.repartition("instrument").sortWithinPartitions("instrument", "i").mapInPandas(run, candidates.schema)


def _round_trips(trips: DataFrame, own: Instrument, costs: Costs, side: Column, qty: int) -> DataFrame:
    """Fills of trips (instrument, i, entry and exit structs of ts, reference, taker, tag, high, low; exit null while open)."""
    legs = F.array(F.struct(F.lit(0).alias("n"), F.col("entry").alias("x")), F.struct(F.lit(1).alias("n"), F.col("exit").alias("x")))
    rows = trips.withColumn("_side", side).withColumn("leg", F.explode(legs)).where("leg.x is not null")
    return charged(
        rows.select("instrument", F.col("leg.x.ts").alias("ts_us"), (2 * F.col("i") + F.col("leg.n")).alias("seq"), F.when(F.col("leg.n") == 0, F.col("_side")).otherwise(-F.col("_side")).alias("side"), F.lit(qty).cast("long").alias("qty"), "leg.x.reference", "leg.x.taker", "leg.x.tag", "leg.x.high", "leg.x.low"),
        own, costs,
    )


def _timed(bars: DataFrame) -> DataFrame:
    """Bars of ticks without a time have no place among the others."""
    return bars.where("close_ts is not null")


def _next(column: str) -> Column:
    return F.lead(column).over(by_time())


def _leg(ts, reference, taker, tag, high, low) -> Column:
    return F.struct(ts.alias("ts"), reference.alias("reference"), taker.alias("taker"), tag.alias("tag"), high.alias("high"), low.alias("low"))


def _entries(rows: DataFrame) -> DataFrame:
    """rows with entry: the market fill at the next bar's open."""
    return rows.withColumn("entry", F.when(_next("close_ts").isNotNull(), _leg(_next("close_ts"), _next("open"), F.lit(True), F.lit("entry"), _next("high"), _next("low"))))


def breakout(bars: DataFrame, own: Instrument, costs: Costs, lookback: int = 48, atr: int = 14, stop: float = 2.0, target: float = 3.0, volume: float = 1.2, qty: int = 1, policy: str = "pessimistic") -> DataFrame:
    """Buys a close above the highest high of the bars before it on high volume, and brackets the entry by multiples of the average true range."""
    if lookback < 2 or stop <= 0 or target <= 0 or qty <= 0:
        raise ConfigError("lookback must be 2 at least, the others positive")
    bars = _timed(bars)
    channel = indicators.channel(lookback)
    rows = _entries(numbered(indicators.atr(bars, atr, "_atr"))).withColumn("_top", channel["highest"]).withColumn("_mean", channel["mean_volume"])
    signal = (F.col("close") > F.col("_top")) & ~((F.col("_mean") > 0) & (F.col("volume") < F.col("_mean") * volume)) & (F.col("_atr") > 0) & F.col("entry").isNotNull()
    paid = costs.price(own, F.col("entry.reference"), F.lit(1), F.lit(True), F.col("entry.high") - F.col("entry.low"))
    level = lambda x: (F.floor(x / own.tick + 0.5) * own.tick).cast("long")
    hits = rows.where(signal).select("instrument", "i", "entry", (F.col("i") + 2).alias("start"), F.lit(1).alias("side"), level(paid - F.col("_atr") * stop).alias("stop"), level(paid + F.col("_atr") * target).alias("target"))
    b = numbered(bars)
    ended = matching.brackets(hits, b, matching.levels(b), policy)
    out = _leg(F.col("exit_ts"), F.col("exit_price"), F.col("leg") == "stop", F.col("leg"), F.col("exit_price"), F.col("exit_price"))
    trips = without_overlap(ended.select("instrument", "i", "exit_i", "entry", F.when(F.col("exit_i").isNotNull(), out).alias("exit")))
    return _round_trips(trips, own, costs, F.lit(1), qty)


def _first_later(when: Column) -> Column:
    """Number of the first bar from this one on for which it holds: a running value over the bars backwards."""
    w = Window.partitionBy("instrument").orderBy(F.col("close_ts").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(when, F.col("i")), ignorenulls=True).over(w)


def _exit_at(rows: DataFrame, b: DataFrame, decided: str, tag: Column) -> DataFrame:
    """rows with exit_i and exit: the market fill at the open of the bar after that numbered ``decided``."""
    at = b.select(F.col("instrument").alias("_j"), F.col("i").alias("exit_i"), _leg(F.col("close_ts"), F.col("open"), F.lit(True), F.lit("exit"), F.col("high"), F.col("low")).alias("exit"))
    met = rows.join(at, (F.col("instrument") == F.col("_j")) & (F.col(decided) + 1 == F.col("exit_i")), "left").drop("_j")
    return met.withColumn("exit", F.when(F.col("exit").isNotNull(), F.col("exit").withField("tag", tag)))


def mean_reversion(bars: DataFrame, own: Instrument, costs: Costs, rsi: int = 14, entry: float = 30, exit: float = 55, most_bars: int = 48, qty: int = 1) -> DataFrame:
    """Buys when the strength index is low; sells when it is high again, or after so many bars."""
    if entry >= exit or most_bars < 1 or qty <= 0:
        raise ConfigError("entry must be below exit, the others positive")
    b = numbered(indicators.rsi(_timed(bars), rsi, name="_rsi"))
    # From the bar after the signal on, the position is held and may be given up.
    rows = _entries(b).withColumn("_high", _first_later(F.col("_rsi") > exit)).withColumn("_high", _next("_high"))
    decided = F.least(F.coalesce("_high", F.col("i") + most_bars), F.col("i") + most_bars)
    hits = rows.where((F.col("_rsi") < entry) & F.col("entry").isNotNull()).select("instrument", "i", "entry", decided.alias("_end"), (F.coalesce("_high", F.lit(2**62)) <= F.col("i") + most_bars).alias("_by_index"))
    ended = _exit_at(hits, b, "_end", F.when(F.col("_by_index"), "exit").otherwise("time-stop"))
    return _round_trips(without_overlap(ended.select("instrument", "i", "exit_i", "entry", "exit")), own, costs, F.lit(1), qty)


def session_breakout(bars: DataFrame, own: Instrument, costs: Costs, period: int = 20, deviations: float = 2.0, stop_atr: float = 2.0, no_entry_minutes: int = 30, qty: int = 1, session_end: Column | None = None) -> DataFrame:
    """Follows a close outside the Bollinger bands with a protective stop for the session, and is flat before it ends. ``session_end`` is the end of a bar's session,
    by default the next midnight after its open."""
    bars = _timed(bars)
    end = session_end if session_end is not None else F.col("open_ts") - F.pmod("open_ts", F.lit(86_400_000_000)) + 86_400_000_000
    bands = indicators.bollinger(period, deviations)
    rows = numbered(indicators.atr(bars, period, "_atr")).withColumn("_left", end - F.col("close_ts")).withColumn("_up", bands["upper"]).withColumn("_down", bands["lower"])
    # An exit goes out a bar early, as it fills at the next open.
    rows = _entries(rows).withColumn("_close", _first_later(F.col("_left") <= F.col("close_ts") - F.col("open_ts"))).withColumn("_close", _next("_close"))
    side = F.when(F.col("close") > F.col("_up"), 1).when(F.col("close") < F.col("_down"), -1)
    rows = rows.withColumn("side", side).where(F.col("side").isNotNull() & (F.col("_left") > no_entry_minutes * 60_000_000) & F.col("entry").isNotNull())
    paid = costs.price(own, F.col("entry.reference"), F.col("side"), F.lit(True), F.col("entry.high") - F.col("entry.low"))
    away = F.greatest(F.lit(own.tick), (F.floor(F.col("_atr") * stop_atr / own.tick + 0.5) * own.tick).cast("long"))
    hits = rows.select("instrument", "i", "side", "entry", "_close", (F.col("i") + 2).alias("start"), (paid - F.col("side") * away).alias("stop"), F.lit(None).cast("long").alias("target"))
    b = numbered(bars)
    stopped = matching.brackets(hits, b, matching.levels(b)).withColumnsRenamed({"exit_i": "_stop_i", "exit_ts": "_stop_ts", "exit_price": "_stop_price"})
    ended = _exit_at(stopped, b, "_close", F.lit("end-of-session"))
    early = F.col("_stop_i").isNotNull() & (F.col("_stop_i") <= F.coalesce("_close", F.lit(2**62)))
    leg = _leg(F.col("_stop_ts"), F.col("_stop_price"), F.lit(True), F.lit("protective-stop"), F.col("_stop_price"), F.col("_stop_price"))
    trips = ended.select("instrument", "i", F.when(early, F.col("_stop_i")).otherwise(F.col("exit_i")).alias("exit_i"), "side", "entry", F.when(early, leg).otherwise(F.col("exit")).alias("exit"))
    return _round_trips(without_overlap(trips), own, costs, F.col("side"), qty)


STRATEGIES = {"sma-crossover": crossover, "breakout": breakout, "mean-reversion": mean_reversion, "session-breakout": session_breakout}
