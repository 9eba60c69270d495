"""Indicators over bars, per instrument, null until they have enough bars.

Those with a fixed reach are window expressions. Recursive ones (exponential averages and what builds on them) are window sums in blocks
(``smoothed``). An instrument has one bar for each close.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators.bars import by_time, price


def _last(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def _full(n: int) -> Column:
    return F.count(F.lit(1)).over(_last(n)) == n


def sma(n: int, source: str = "close") -> Column:
    """Mean of the last n."""
    return F.when(_full(n), F.avg(price(source)).over(_last(n)))


def sum_of_last(n: int, source: str = "close") -> Column:
    """Sum of the last n as an integer: for comparisons that must not depend on how a mean was added up."""
    return F.when(_full(n), F.sum(price(source)).over(_last(n)))


def moving_sums(bars: DataFrame, periods: dict[str, int], source: str = "close") -> DataFrame:
    """bars with the sums of the last n of an integer price, by name: differences of one running sum, so that the cost does not grow with n."""
    w = by_time()
    rows = bars.withColumn("_sum", F.sum(price(source)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    for name, n in periods.items():
        rows = rows.withColumn(name, F.when(F.col("_n") >= n, F.col("_sum") - F.coalesce(F.lag("_sum", n).over(w), F.lit(0))))
    return rows.drop("_sum", "_n")


def rolling_stats(n: int, source: str = "close") -> dict[str, Column]:
    """mean, variance and std_dev of the population of the last n."""
    w = _last(n)
    return {"mean": F.when(_full(n), F.avg(price(source)).over(w)), "variance": F.when(_full(n), F.var_pop(price(source)).over(w)), "std_dev": F.when(_full(n), F.stddev_pop(price(source)).over(w))}


def bollinger(n: int = 20, k: float = 2.0, source: str = "close") -> dict[str, Column]:
    """middle, upper, lower and bandwidth."""
    s = rolling_stats(n, source)
    up, down = s["mean"] + k * s["std_dev"], s["mean"] - k * s["std_dev"]
    return {"middle": s["mean"], "upper": up, "lower": down, "bandwidth": F.when(s["mean"] == 0, 0.0).otherwise((up - down) / F.nullif(s["mean"], F.lit(0.0)))}


def vwap(reset: str = "day", source: str = "hlc3") -> Column:
    """Mean price weighted by volume, since the start of the UTC day of the close, or since ever; bars without volume add nothing."""
    keys = ("instrument", times.day_index(F.col("close_ts"))) if reset == "day" else ("instrument",)
    w = Window.partitionBy(*keys).orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    volume = F.sum("volume").over(w)
    return F.when(volume > 0, F.sum(price(source) * F.col("volume")).over(w) / F.nullif(volume, F.lit(0)))


def channel(n: int) -> dict[str, Column]:
    """The n bars before this one: their highest high, lowest low and mean volume."""
    w = by_time().rowsBetween(-n, -1)
    full = F.count(F.lit(1)).over(w) == n
    return {"highest": F.when(full, F.max("high").over(w)), "lowest": F.when(full, F.min("low").over(w)), "mean_volume": F.when(full, F.avg("volume").over(w))}


def true_range() -> Column:
    """The bar's range, reaching to the close before it."""
    before = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0)))


# Recursive indicators: v moves by alpha toward each new value, v = (1 - alpha) v + alpha x, which is affine in the v before.

#: A block ends when what it began with has faded to 2 ** -FADED of itself; powers within a block stay within a double's range.
FADED = 600


def smoothed(bars: DataFrame, x: Column, n: int, alpha: float, name: str) -> DataFrame:
    """bars with the smoothed series of x: null until n defined values have come, then their mean, which each further value moves by alpha.

    With q = 1 - alpha, a value is q ** j times the running sum of e / q ** j, e being what enters at place j. A series is cut into blocks
    that are so long that what a block begins with is gone at its end; so a block needs no more than the end of the one before it, and all
    are window sums over one shuffle by instrument. No blocks where alpha is 1, as nothing is carried.
    """
    w = by_time()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("_x", x.cast("double"))
    # The first n values enter as their mean, at the place of the last of them.
    rows = rows.withColumn("_k", F.when(F.col("_x").isNotNull(), F.count("_x").over(so_far) - n)).withColumn("_seed", F.avg("_x").over(so_far))
    if alpha == 1:
        return rows.withColumn(name, F.when(F.col("_k") >= 0, F.col("_x"))).drop("_x", "_k", "_seed")
    q, length = F.lit(1 - alpha), max(1, math.ceil(FADED / -math.log2(1 - alpha)))
    enters = F.when(F.col("_k") == 0, F.col("_seed")).when(F.col("_k") > 0, alpha * F.col("_x"))
    rows = rows.withColumn("_j", F.col("_k") % length).withColumn("_block", F.when(F.col("_k") >= 0, F.floor(F.col("_k") / length)))
    block = Window.partitionBy("instrument", "_block").orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(enters * F.pow(q, -F.col("_j"))).over(block) * F.pow(q, "_j"))
    end = F.last(F.when(F.col("_j") == length - 1, F.col("_own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    value = F.col("_own") + F.coalesce(end, F.lit(0.0)) * F.pow(q, F.col("_j") + 1)
    return rows.withColumn(name, F.when(F.col("_k") >= 0, value)).drop("_x", "_k", "_seed", "_j", "_block", "_own")


def ema(bars: DataFrame, n: int, source: str | Column = "close", name: str = "ema") -> DataFrame:
    return smoothed(bars, price(source) if isinstance(source, str) else source, n, 2.0 / (n + 1), name)


def rma(bars: DataFrame, n: int, source: str | Column = "close", name: str = "rma") -> DataFrame:
    return smoothed(bars, price(source) if isinstance(source, str) else source, n, 1.0 / n, name)


def rsi(bars: DataFrame, n: int = 14, source: str = "close", name: str = "rsi") -> DataFrame:
    rows = bars.withColumn("_change", price(source) - F.lag(price(source)).over(by_time()))
    both = rma(rma(rows, n, F.greatest("_change", F.lit(0)) + F.col("_change") * 0, "_gain"), n, F.greatest(-F.col("_change"), F.lit(0)) + F.col("_change") * 0, "_loss")
    gain, loss = F.col("_gain"), F.col("_loss")
    value = F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return both.withColumn(name, F.when(gain.isNotNull(), value)).drop("_change", "_gain", "_loss")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, source: str = "close") -> DataFrame:
    """bars with macd, signal and histogram."""
    if fast >= slow:
        raise ValueError("the fast period must be below the slow one")
    line = ema(ema(bars, fast, source, "_fast"), slow, source, "_slow").withColumn("_line", F.col("_fast") - F.col("_slow"))
    out = ema(line, signal, F.col("_line"), "signal")
    return out.withColumn("macd", F.when(F.col("signal").isNotNull(), F.col("_line"))).withColumn("histogram", F.col("_line") - F.col("signal")).drop("_fast", "_slow", "_line")


def atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return rma(bars.withColumn("_range", true_range()), n, F.col("_range"), name).drop("_range")
