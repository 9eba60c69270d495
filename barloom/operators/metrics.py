"""Risk, return and trade statistics of equity curves and trades; null where a figure has no meaning.

Equity curves are (run, ts, equity), money in 10^-8. Windows are keyed by run; what has one row a run is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import fixed, times

YEAR = 365.25 * times.DAY
LEAST_RETURNS, LEAST_SPAN = 30, 30 * times.DAY


def _w():
    return Window.partitionBy("run").orderBy("ts")


def returns(equity: DataFrame) -> DataFrame:
    """run, ts, r: simple returns, up to the first point whose predecessor is not positive."""
    rows = equity.withColumn("prev", F.lag("equity").over(_w()))
    rows = rows.withColumn("low", F.min("prev").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("prev is not null and low > 0").select("run", "ts", (F.col("equity") / F.col("prev") - 1).alias("r"))


def underwater(equity: DataFrame) -> DataFrame:
    """run, ts, peak, depth: how far below the highest equity so far; 0 while that is not positive."""
    peak = F.max("equity").over(_w().rowsBetween(Window.unboundedPreceding, 0))
    rows = equity.withColumn("peak", peak)
    return rows.select("run", "ts", "peak", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0).alias("depth"))


def drawdowns(equity: DataFrame) -> DataFrame:
    """Episodes: run, peak_ts, trough_ts, recovered_ts (null while open), depth, depth_money, bars (from the peak to the recovery or the end)."""
    w = _w()
    before = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = equity.withColumn("i", F.row_number().over(w)).withColumn("top", F.coalesce(F.col("equity") >= before, F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("top").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("run")))
    spans = rows.groupBy("run", "island").agg(
        F.min("ts").alias("peak_ts"), F.min_by("equity", "ts").alias("peak"), F.min(F.struct("equity", "ts")).alias("low"), F.min("i").alias("first"), F.max("i").alias("last"), F.max("n").alias("n")
    )
    tops = rows.where("top").select("run", (F.col("island") - 1).alias("island"), F.col("ts").alias("recovered_ts"))
    out = spans.where("last > first").join(tops, ["run", "island"], "left")
    money = F.col("peak") - F.col("low.equity")
    # An open episode counts the bars that it has.
    return out.select(
        "run", "peak_ts", F.col("low.ts").alias("trough_ts"), "recovered_ts", F.when(F.col("peak") > 0, money / F.col("peak")).otherwise(0.0).alias("depth"), money.alias("depth_money"),
        (F.when(F.col("recovered_ts").isNull(), F.col("n")).otherwise(F.col("last") + 1) - F.col("first")).alias("bars"),
    )


def periods_per_year(equity: DataFrame) -> DataFrame:
    """run, ppy: a year over the median gap; 0 with fewer than three points."""
    gaps = equity.withColumn("gap", F.col("ts") - F.lag("ts").over(_w()))
    return gaps.groupBy("run").agg(F.when(F.count("*") >= 3, YEAR / F.nullif(F.median("gap"), F.lit(0.0))).otherwise(0.0).alias("ppy"))


def risk(equity: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """run, n_returns, volatility, sharpe, sortino; null below LEAST_RETURNS returns or without variation."""
    r = returns(equity).join(periods_per_year(equity), "run").withColumn("x", F.col("r") - (F.pow(F.lit(1 + risk_free), F.when(F.col("ppy") > 0, 1 / F.nullif(F.col("ppy"), F.lit(0.0))).otherwise(0.0)) - 1))
    agg = r.groupBy("run").agg(F.count("*").alias("n_returns"), F.avg("x").alias("m"), F.stddev_samp("r").alias("s"), F.sqrt(F.avg(F.pow(F.least(F.col("x"), F.lit(0.0)), 2))).alias("d"), F.max("ppy").alias("ppy"))
    enough = (F.col("n_returns") >= LEAST_RETURNS) & (F.col("ppy") > 0)
    root = F.sqrt("ppy")
    over = lambda s: F.when(enough & (F.col(s) > 0), F.col("m") / F.nullif(F.col(s), F.lit(0.0)) * root)
    return agg.select("run", "n_returns", F.when(enough, F.col("s") * root).alias("volatility"), over("s").alias("sharpe"), over("d").alias("sortino"))


def growth(equity: DataFrame) -> DataFrame:
    """run, total_return, cagr, max_drawdown, calmar. CAGR needs LEAST_SPAN and positive equity at both ends."""
    ends = equity.groupBy("run").agg(F.min_by("equity", "ts").alias("a"), F.max_by("equity", "ts").alias("z"), (F.max("ts") - F.min("ts")).alias("span"))
    deep = underwater(equity).groupBy("run").agg(F.max("depth").alias("max_drawdown"))
    total = F.when(F.col("a") > 0, F.col("z") / F.nullif(F.col("a"), F.lit(0)) - 1)
    ok = (F.col("span") >= LEAST_SPAN) & (F.col("a") > 0) & (F.col("z") > 0)
    cagr = F.when(ok, F.pow(F.col("z") / F.nullif(F.col("a"), F.lit(0)), YEAR / F.nullif(F.col("span"), F.lit(0))) - 1)
    out = ends.join(deep, "run").select("run", total.alias("total_return"), cagr.alias("cagr"), "max_drawdown")
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.nullif(F.col("max_drawdown"), F.lit(0.0))))


def trade_stats(trades: DataFrame) -> DataFrame:
    """By run, from trades (run, net, gross, bars): counts, money and ratios. A trade that nets nothing neither wins nor loses."""
    net = F.col("net")
    agg = trades.groupBy("run").agg(
        F.count("*").alias("trades"), F.count_if(net > 0).alias("wins"), F.count_if(net < 0).alias("losses"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0)).alias("gross_profit"), F.coalesce(-F.sum(F.when(net < 0, net)), F.lit(0)).alias("gross_loss"), F.sum(net).alias("net"),
        F.coalesce(F.max(F.when(net > 0, net)), F.lit(0)).alias("largest_win"), F.coalesce(F.max(F.when(net < 0, -net)), F.lit(0)).alias("largest_loss"), F.sum("gross").alias("pre_cost"), F.avg("bars").alias("avg_bars"),
    )
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.nullif(F.col(b), F.lit(0)))
    mean = lambda a, b: F.when(F.col(b) == 0, F.lit(0)).otherwise(fixed.js_round(F.col(a) / F.nullif(F.col(b), F.lit(0)))).cast("long")
    return agg.select(
        "run", "trades", "wins", "losses", "gross_profit", "gross_loss", "largest_win", "largest_loss", "pre_cost", "avg_bars",
        ratio("wins", "trades").alias("win_rate"), ratio("gross_profit", "gross_loss").alias("profit_factor"), mean("net", "trades").alias("expectancy"), mean("gross_profit", "wins").alias("avg_win"), mean("gross_loss", "losses").alias("avg_loss"),
    )


def break_even(units: Column, pre_cost: Column, commission: Column, unit: int) -> tuple[Column, Column]:
    """Commission by unit (rounded), and the commission by unit at which nothing is left; null without units or profit. units are in 1/unit."""
    some = F.nullif(units, F.lit(0))
    return fixed.mul_div(commission, unit, some, "half-up"), F.when((units > 0) & (pre_cost > 0), fixed.mul_div(pre_cost, unit, some, "floor"))


def histogram(values: DataFrame, value: str, bins: int = 31) -> DataFrame:
    """run, bin, n: bins of equal width over each run's range, the last one closed; a constant series is widened by one on both sides."""
    ends = values.groupBy("run").agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("z"))
    ends = ends.select("run", F.when(F.col("a") == F.col("z"), F.col("a") - 1).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("z"), F.col("z") + 1).otherwise(F.col("z")).alias("z"))
    rows = values.select("run", F.col(value).cast("double").alias("v")).where("v is not null").join(ends, "run")
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / ((F.col("z") - F.col("a")) / bins)).cast("int"))
    return rows.groupBy("run", bin_.alias("bin")).agg(F.count("*").alias("n"))


def downsample(series: DataFrame, value: str, buckets: int = 600) -> DataFrame:
    """run, ts, value: each bucket's least and greatest value (the first of equals) in time order; all points of a series of at most two
    for each bucket."""
    w = _w()
    rows = series.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("run")))
    bucket = F.call_function("div", (F.col("i") + 1) * buckets - 1, F.col("n"))
    rows = rows.withColumn("bucket", F.when(F.col("n") <= 2 * buckets, F.col("i")).otherwise(bucket))
    ends = rows.groupBy("run", "bucket").agg(F.min(F.struct(F.col(value), "i", "ts")).alias("low"), F.max(F.struct(F.col(value), -F.col("i"), "ts")).alias("high"))
    points = ends.select("run", F.explode(F.array_distinct(F.array(F.struct(F.col("low.ts").alias("ts"), F.col(f"low.{value}").alias(value)), F.struct(F.col("high.ts").alias("ts"), F.col(f"high.{value}").alias(value))))).alias("p"))
    return points.select("run", "p.ts", f"p.{value}")
