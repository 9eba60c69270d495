"""Runs: what a strategy's fills make of an account, as one table of events for reports and the store."""

from __future__ import annotations

import math
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import fixed
from barloom.operators import ledger
from barloom.operators.bars import by_time
from barloom.operators.instruments import VENUE_PRESETS, Costs, Instrument, presets_for
from barloom.operators.lookups import as_of
from barloom.operators.strategies import STRATEGIES
from barloom.session import written

EVENT_SCHEMA = (
    "kind string, ts long, seq long, order_id long, instrument string, side int, type string, price long, qty long, leaves long, commission long, slippage long, liquidity string, tag string, reason string, "
    "amount long, exit_ts long, exit_price long, bars long, mae long, mfe long"
)
CASH = 10_000_000 * 10**8


def account(bars: DataFrame, fills: DataFrame, own: Instrument, cash: int = CASH) -> DataFrame:
    """bars (instrument, close_ts, close) with position, cash and equity of each instrument's account at their closes. Cash pays for what is bought; with margin the equity is the
    same."""
    money = fixed.price_delta_to_money(F.col("price"), F.col("side") * F.col("qty"), own.point_value, own.divisor)
    flows = fills.groupBy("instrument", F.col("ts_us").alias("close_ts")).agg(F.sum(F.col("side") * F.col("qty")).alias("_bought"), F.sum(-money - F.col("commission")).alias("_flow"))
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.select("instrument", "close_ts", "close").join(flows, ["instrument", "close_ts"], "left")
    rows = rows.withColumn("position", F.coalesce(F.sum("_bought").over(w), F.lit(0))).withColumn("cash", F.lit(cash) + F.coalesce(F.sum("_flow").over(w), F.lit(0)))
    worth = fixed.price_delta_to_money(F.col("close"), F.col("position"), own.point_value, own.divisor)
    return rows.withColumn("equity", F.col("cash") + worth).drop("_bought", "_flow")


def closed_trades(bars: DataFrame, fills: DataFrame, own: Instrument) -> DataFrame:
    """Flat-to-flat trades: instrument, trade, direction, qty, entry_ts, exit_ts, entry_price, exit_price (means, halves to even), gross, commission, net, bars (held at their closes),
    mae and mfe (worst and best result at these closes). What rests on a fill without a price is null."""
    rows = ledger.trade_ids(fills)
    turns = F.col("ends") & (F.col("position") != 0)
    parts = rows.select("*", F.explode(F.when(turns, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    qty = F.when(F.col("part") == 1, F.abs("position")).when(turns, F.abs("before")).otherwise(F.col("qty"))
    parts = parts.withColumn("_qty", qty.cast("long")).withColumn("trade", F.col("trade") + F.col("part")).withColumn("_closes", F.col("ends") & (F.col("part") == 0))
    # What turns a position over pays its commission with the trade that it ends.
    parts = parts.withColumn("_fee", F.when(F.col("part") == 0, F.col("commission")).otherwise(F.lit(0))).withColumn("_money", fixed.price_delta_to_money(F.col("price"), F.col("side") * F.col("_qty"), own.point_value, own.divisor))
    first = Window.partitionBy("instrument", "trade").orderBy("ts_us", "seq")
    parts = parts.withColumn("_direction", F.first("side").over(first))
    opens = F.col("side") == F.col("_direction")
    total = lambda c, when: F.when(F.count_if(when & c.isNull()) == 0, F.coalesce(F.sum(F.when(when, c)), F.lit(0)))
    whole = parts.groupBy("instrument", "trade").agg(
        F.max("_direction").alias("direction"), F.min("ts_us").alias("entry_ts"), F.max("ts_us").alias("exit_ts"), (-total(F.col("_money"), F.lit(True))).alias("gross"), F.sum("_fee").alias("commission"), F.max("_closes").alias("_closed"),
        total(F.col("_qty"), opens).alias("qty"), total(F.col("_qty") * F.col("price"), opens).alias("_in"), total(F.col("_qty") * F.col("price"), ~opens).alias("_out"),
    )
    mean = lambda c: fixed.narrow(fixed.divide(F.col(c), F.nullif(F.col("qty"), F.lit(0)), "half-even"))
    trades = whole.where("_closed").withColumn("entry_price", mean("_in")).withColumn("exit_price", mean("_out"))
    begun = trades.select("instrument", F.col("entry_ts").alias("_entry"), F.col("exit_ts").alias("_exit"), "trade", "direction", "qty", "entry_price")
    held = as_of(bars.select("instrument", "close_ts", "close"), begun.dropDuplicates(["instrument", "_entry"]), "instrument", "close_ts", "_entry", ["trade", "direction", "qty", "entry_price", "_exit"]).where("close_ts < _exit")
    result = fixed.price_delta_to_money(F.col("close") - F.col("entry_price"), F.col("direction") * F.col("qty"), own.point_value, own.divisor)
    reach = held.groupBy("instrument", "trade").agg(F.count("*").alias("bars"), F.min(result).alias("mae"), F.max(result).alias("mfe"))
    out = trades.join(reach, ["instrument", "trade"], "left")
    return out.select("instrument", "trade", "direction", "qty", "entry_ts", "exit_ts", "entry_price", "exit_price", "gross", "commission", (F.col("gross") - F.col("commission")).alias("net"), F.coalesce("bars", F.lit(0)).alias("bars"), F.coalesce("mae", F.lit(0)).alias("mae"), F.coalesce("mfe", F.lit(0)).alias("mfe"))


def run(bars: DataFrame, strategy: str, own: Instrument, costs: Costs, run_id: Column, cash: int = CASH, **params) -> DataFrame:
    """Events (run_id and EVENT_SCHEMA) of a strategy over the bars: each instrument is a run with an account of its own, named by run_id (of the column instrument)."""
    # Fills are few, and the account, the trades and the books all read them.
    fills = written(STRATEGIES[strategy](bars, own, costs, **params), "fills")
    equity = account(bars, fills, own, cash)
    trades = closed_trades(bars, fills, own)
    realised = ledger.cost_basis(fills.select("instrument", "ts_us", "seq", "side", "qty", "price", "commission", "slippage", "taker", "tag"), own.point_value, own.divisor)
    n = F.row_number().over(Window.partitionBy("instrument").orderBy("ts_us", "seq"))
    paid = fills.groupBy("instrument").agg(F.sum("commission").alias("_paid"), F.count("*").alias("_fills"))
    got = realised.groupBy("instrument").agg(F.sum("realised").alias("_got"))
    last = equity.groupBy("instrument").agg(F.max_by(F.struct("close_ts", "cash", "equity"), "close_ts").alias("x")).join(paid, "instrument", "left").join(got, "instrument", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    parts = [
        realised.select(F.lit("fill").alias("kind"), F.col("ts_us").alias("ts"), n.cast("long").alias("seq"), "instrument", "side", F.lit("market").alias("type"), "price", "qty", F.lit(0).cast("long").alias("leaves"), "commission", "slippage", F.when(F.col("taker"), "taker").otherwise("maker").alias("liquidity"), "tag", F.col("realised").alias("amount")),
        trades.select(F.lit("trade").alias("kind"), F.col("entry_ts").alias("ts"), F.col("trade").alias("seq"), "instrument", F.col("direction").alias("side"), F.col("entry_price").alias("price"), "qty", "commission", F.col("gross").alias("amount"), "exit_ts", "exit_price", "bars", "mae", "mfe"),
        equity.select(F.lit("equity").alias("kind"), F.col("close_ts").alias("ts"), "instrument", F.col("cash").alias("price"), F.col("position").alias("qty"), F.col("equity").alias("amount")),
        last.select(F.lit("final").alias("kind"), F.col("x.close_ts").alias("ts"), "instrument", F.col("x.cash").alias("price"), zero("_paid").alias("commission"), zero("_got").alias("slippage"), F.col("x.equity").alias("amount")),
        last.select(F.lit("count").alias("kind"), F.col("x.close_ts").alias("ts"), "instrument", F.lit("fills").alias("reason"), zero("_fills").alias("amount")),
    ]
    fields = [f.split() for f in EVENT_SCHEMA.split(", ")]
    rows = [p.select(run_id.alias("run_id"), *((F.col(c) if c in p.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields)) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    # Reports ask a run many things; it is made once.
    return written(out, "run")


#: Parameters of strategies that a configuration may set: kind, default, least and most (fixed bounds).
PARAMS: dict[str, dict[str, tuple]] = {
    "sma-crossover": {"fast": (int, 24, 1, 1_000), "slow": (int, 72, 2, 5_000), "short": (bool, True, None, None)},
    "breakout": {"lookback": (int, 48, 2, 5_000), "atr": (int, 14, 1, 1_000), "stop": (float, 2.0, 0.01, 100), "target": (float, 3.0, 0.01, 100), "volume": (float, 1.2, 0, 100)},
    "mean-reversion": {"rsi": (int, 14, 1, 1_000), "entry": (float, 30.0, 0, 100), "exit": (float, 55.0, 0, 100), "most_bars": (int, 48, 1, 10_000)},
    "session-breakout": {"period": (int, 20, 2, 1_000), "deviations": (float, 2.0, 0.01, 100), "stop_atr": (float, 2.0, 0.01, 100), "no_entry_minutes": (int, 30, 0, 1_440)},
}
TIMEFRAMES = ("1h", "4h", "1d")


@dataclass(frozen=True)
class Config:
    """A run that can be written into a link: market (venue-symbol), timeframe, strategy with its parameters, position size in money, and costs."""

    market: str
    timeframe: str
    strategy: str
    params: dict
    size: float
    costs: str

    def query(self) -> str:
        shown = lambda v: str(int(v)) if isinstance(v, bool) else f"{v:g}"
        return urlencode({"symbol": self.market, "tf": self.timeframe, "strategy": self.strategy, "size": f"{self.size:g}", "costs": self.costs} | {f"p.{k}": shown(v) for k, v in self.params.items()})


def parse_config(query: str) -> Config | None:
    """A run from a link's query; None if anything in it is out of bounds, since a corrected link would report a run that nobody asked for."""
    given = dict(parse_qsl(query.lstrip("?"), keep_blank_values=True))
    strategy, timeframe, market, costs = given.get("strategy", "sma-crossover"), given.get("tf", "1h"), given.get("symbol", ""), given.get("costs", "")
    # A market without a venue is the first venue's, as links have always meant.
    market = market if "-" in market else f"binance-{market}"
    venue, _, symbol = market.partition("-")
    if not symbol or venue not in VENUE_PRESETS or costs not in presets_for(market) or timeframe not in TIMEFRAMES or strategy not in PARAMS:
        return None

    def number(text: str) -> float | None:
        try:
            return x if math.isfinite(x := float(text)) else None
        except ValueError:
            return None

    size, params = number(given.get("size", "")), {}
    if size is None or not 0 < size <= 1e12:
        return None
    for name, (kind, default, least, most) in PARAMS[strategy].items():
        text = given.get(f"p.{name}")
        if text is None:
            params[name] = default
        elif kind is bool:
            if text not in ("0", "1"):
                return None
            params[name] = text == "1"
        else:
            x = number(text)
            if x is None or not least <= x <= most or kind is int and x != int(x):
                return None
            params[name] = kind(x)
    return Config(market, timeframe, strategy, params, size, costs)


def exposure(events: DataFrame) -> DataFrame:
    """run_id, trades, avg_bars and exposure: bars held by closed trades, on average and as a share of all bars."""
    held = events.groupBy("run_id").agg(F.count_if(F.col("kind") == "trade").alias("trades"), F.sum(F.when(F.col("kind") == "trade", F.col("bars"))).alias("_held"), F.count_if(F.col("kind") == "equity").alias("_bars"))
    ratio = lambda a, b: F.coalesce(F.col(a), F.lit(0)) / F.nullif(F.col(b), F.lit(0))
    return held.select("run_id", "trades", F.coalesce(ratio("_held", "trades"), F.lit(0.0)).alias("avg_bars"), F.coalesce(ratio("_held", "_bars"), F.lit(0.0)).alias("exposure"))


def identity(bars: DataFrame, fills: DataFrame, own: Instrument, cash: int = CASH) -> DataFrame:
    """instrument, gap: what an account's last equity differs from its cash, realised and unrealised results less commission; 0 for sound books."""
    last = account(bars, fills, own, cash).groupBy("instrument").agg(F.max_by(F.struct("equity", "position", "close"), "close_ts").alias("x"))
    books = ledger.cost_basis(fills.select("instrument", "ts_us", "seq", "side", "qty", "price", "commission"), own.point_value, own.divisor).groupBy("instrument").agg(F.sum("realised").alias("got"), F.sum("commission").alias("paid"), F.max_by("basis", F.struct("ts_us", "seq")).alias("basis"))
    worth = fixed.price_delta_to_money(F.col("x.close"), F.col("x.position"), own.point_value, own.divisor)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return last.join(books, "instrument", "left").select("instrument", (F.col("x.equity") - (F.lit(cash) + zero("got") + worth - zero("basis") - zero("paid"))).alias("gap"))


def fills_after(fills: DataFrame, number: int) -> DataFrame:
    """instrument, n: fills that a snapshot with this next number has not seen."""
    return fills.where(F.col("seq") >= number).groupBy("instrument").agg(F.count("*").alias("n"))


def fills(events: DataFrame) -> DataFrame:
    return events.where("kind = 'fill'").select("run_id", "ts", "seq", "order_id", "instrument", "side", "price", "qty", "leaves", "commission", "slippage", "liquidity", "tag")


def trades(events: DataFrame) -> DataFrame:
    return events.where("kind = 'trade'").select(
        "run_id", "instrument", F.col("side").alias("direction"), "qty", F.col("ts").alias("entry_ts"), "exit_ts", F.col("price").alias("entry_price"), "exit_price", F.col("amount").alias("gross"), "commission", (F.col("amount") - F.col("commission")).alias("net"), "bars", "mae", "mfe"
    )


def equity(events: DataFrame) -> DataFrame:
    return events.where("kind = 'equity'").select(F.col("run_id").alias("run"), "ts", F.col("amount").alias("equity"))


def canonical(events: DataFrame) -> DataFrame:
    """run_id, kind, ts, seq and json of each event: exact figures only, fields in one order, nulls left out; sorted by the first four, the same run is the same bytes."""
    record = F.to_json(F.struct("kind", "ts", "seq", "instrument", "side", "price", "qty", "commission", "slippage", "liquidity", "tag", "reason", "amount", "exit_ts", "exit_price", "bars", "mae", "mfe"))
    return events.select("run_id", "kind", "ts", "seq", record.alias("json"))
