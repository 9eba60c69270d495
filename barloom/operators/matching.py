"""Orders that do not depend on each other, matched against all later bars.

The first bar that reaches a price is found by levels: SPAN bars make a unit, SPAN units a unit of the next level, and so on, each
with its lowest low and highest high and with its parts as an array. A search goes up from the order's place until a unit holds a hit,
and down to the bar. So an order meets a few rows for each level, by equality, however late it is reached, and no bar is out of reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import bars as _bars
from barloom.operators.lookups import as_of

SPAN = 64


def _unit(c: Column) -> Column:
    return F.call_function("div", c, F.lit(SPAN))


def levels(numbered: DataFrame) -> list[DataFrame]:
    """instrument, unit and parts (arrays of idx, low, high, and for the first level also open and close_ts) of each level, from units of SPAN bars to one unit
    for each instrument. numbered are bars with their number i."""
    most = numbered.agg(F.max("i")).first()[0]
    part = F.struct(F.col("i").alias("idx"), "low", "high", "open", "close_ts")
    rows, out = numbered.select("instrument", F.col("i").alias("idx"), "low", "high", part.alias("part")), []
    while True:
        units = rows.groupBy("instrument", _unit(F.col("idx")).alias("unit")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list("part")).alias("parts"))
        out.append(units.select("instrument", "unit", "parts"))
        if (most or 0) < SPAN:
            return out
        most //= SPAN
        rows = units.select("instrument", F.col("unit").alias("idx"), "low", "high", F.struct(F.col("unit").alias("idx"), "low", "high").alias("part"))


def first_reached(orders: DataFrame, tables: list[DataFrame], start: str, below: str, above: str, into: str) -> DataFrame:
    """orders (instrument and more) with ``into``: a struct (idx, low, high, open, close_ts) of the first bar numbered ``start`` or more whose low is at most ``below`` or
    whose high is at least ``above``; a null level is never reached. Null if no bar is.
    """

    def hit(parts: Column, since: Column) -> Column:
        reached = lambda p: (p["idx"] >= since) & (F.coalesce(p["low"] <= F.col(below), F.lit(False)) | F.coalesce(p["high"] >= F.col(above), F.lit(False)))
        return F.get(F.filter(parts, reached), F.lit(0))

    def met(rows: DataFrame, table: DataFrame, unit: Column) -> DataFrame:
        side = table.select(F.col("instrument").alias("_i"), F.col("unit").alias("_u"), F.col("parts").alias("_parts"))
        return rows.join(side, (F.col("instrument") == F.col("_i")) & (unit == F.col("_u")), "left").drop("_i", "_u")

    # _at is the place from which a level is searched, _found the number of what was found there and _level its level; _bar is a found bar.
    rows = orders.withColumn("_at", F.col(start).cast("long")).withColumn("_level", F.lit(None).cast("int")).withColumn("_found", F.lit(None).cast("long"))
    for level, table in enumerate(tables):
        open_ = F.col("_level").isNull()
        rows = met(rows, table, F.when(open_, _unit(F.col("_at")))).withColumn("_hit", F.when(open_, hit(F.col("_parts"), F.col("_at"))))
        if level == 0:
            rows = rows.withColumn("_bar", F.col("_hit"))
        rows = rows.withColumn("_found", F.coalesce("_found", "_hit.idx")).withColumn("_level", F.coalesce("_level", F.when(F.col("_hit").isNotNull(), level)))
        rows = rows.withColumn("_at", _unit(F.col("_at")) + 1).drop("_hit", "_parts")
    for level in range(len(tables) - 2, -1, -1):
        down = F.col("_level") > level
        rows = met(rows, tables[level], F.when(down, F.col("_found"))).withColumn("_hit", F.when(down, hit(F.col("_parts"), F.lit(-1))))
        if level == 0:
            rows = rows.withColumn("_bar", F.coalesce("_bar", "_hit"))
        rows = rows.withColumn("_found", F.when(down, F.col("_hit.idx")).otherwise(F.col("_found"))).drop("_hit", "_parts")
    return rows.withColumn(into, F.col("_bar")).drop("_at", "_level", "_found", "_bar")


def placed(orders: DataFrame, numbered: DataFrame, ts: str = "active_from", into: str = "start") -> DataFrame:
    """orders with ``into``: the number of the first bar that closes after ts."""
    seen = as_of(orders, numbered.select("instrument", "close_ts", F.col("i").alias("_seen")), "instrument", ts, "close_ts", ["_seen"])
    return seen.withColumn(into, F.coalesce(F.col("_seen") + 1, F.lit(0))).drop("_seen")


def _better(level: Column, buy: Column) -> Column:
    """A limit order's price: its level, or the open where that is better."""
    return F.when(buy, F.least(level, F.col("_b.open"))).otherwise(F.greatest(level, F.col("_b.open")))


def _worse(level: Column, buy: Column) -> Column:
    """A stop order's price: its level, or the open where that is beyond it."""
    return F.when(buy, F.greatest(level, F.col("_b.open"))).otherwise(F.least(level, F.col("_b.open")))


def first_touch(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """orders (order_id, instrument, active_from, kind limit or stop, side, level) with fill_ts and price of the first later bar that reaches them; null if
    none does."""
    b = _bars.numbered(bars)
    low = (F.col("kind") == "limit") == (F.col("side") > 0)
    rows = placed(orders, b).withColumn("_below", F.when(low, F.col("level"))).withColumn("_above", F.when(~low, F.col("level")))
    rows = first_reached(rows, levels(b), "start", "_below", "_above", "_b")
    buy = F.col("side") > 0
    price = F.when(F.col("kind") == "limit", _better(F.col("level"), buy)).otherwise(_worse(F.col("level"), buy))
    return rows.select(*orders.columns, F.col("_b.close_ts").alias("fill_ts"), F.when(F.col("_b").isNotNull(), price).alias("price"))


#: How a bar that reaches both legs of a bracket is read.
POLICIES = ("pessimistic", "optimistic", "ohlc-path")


def brackets(entries: DataFrame, numbered: DataFrame, tables: list[DataFrame], policy: str = "pessimistic") -> DataFrame:
    """entries (instrument, start, side, stop, target and more) with the exit of a position that one leg closes and the other is cancelled by: exit_i, exit_ts,
    exit_price, leg (stop or target) and ambiguous (the bar reached both). side is the position's; the first bar looked at is numbered start.

    A bar that reaches both stops pessimistically and reaches its target optimistically; on the path it goes first to the extreme that is nearer to its open (the
    low where they are equally near).
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    long = F.col("side") > 0
    rows = entries.withColumn("_below", F.when(long, F.col("stop")).otherwise(F.col("target"))).withColumn("_above", F.when(long, F.col("target")).otherwise(F.col("stop")))
    rows = first_reached(rows, tables, "start", "_below", "_above", "_b")
    # A leg that is null is not reached.
    low, high = (F.coalesce(c, F.lit(False)) for c in (F.col("_b.low") <= F.col("_below"), F.col("_b.high") >= F.col("_above")))
    both = low & high
    # A bar that opens beyond a leg has reached it first, whatever the policy.
    at_low, at_high = F.col("_b.open") <= F.col("_below"), F.col("_b.open") >= F.col("_above")
    path_low = F.col("_b.open") - F.col("_b.low") <= F.col("_b.high") - F.col("_b.open")
    first_low = {"pessimistic": long, "optimistic": ~long, "ohlc-path": path_low}[policy]
    by_low = F.when(at_low, True).when(at_high, False).when(both, first_low).otherwise(low)
    leg = F.when(by_low == long, "stop").otherwise("target")
    price = F.when(leg == "stop", _worse(F.col("stop"), ~long)).otherwise(_better(F.col("target"), ~long))
    some = F.col("_b").isNotNull()
    return rows.select(
        *entries.columns, F.col("_b.idx").alias("exit_i"), F.col("_b.close_ts").alias("exit_ts"), F.when(some, price).alias("exit_price"), F.when(some, leg).alias("leg"), (both & ~F.coalesce(at_low | at_high, F.lit(False))).alias("ambiguous")
    )


def stop_limits(orders: DataFrame, bars: DataFrame, policy: str = "pessimistic") -> DataFrame:
    """orders (instrument, active_from, side, stop, limit and more) with trigger_ts, fill_ts, price and deferred: a stop that is reached puts its limit into the
    book, pessimistically from the next bar on, optimistically within the same one."""
    b = _bars.numbered(bars)
    tables, buy = levels(b), F.col("side") > 0
    rows = placed(orders, b).withColumn("_below", F.when(~buy, F.col("stop"))).withColumn("_above", F.when(buy, F.col("stop")))
    rows = first_reached(rows, tables, "start", "_below", "_above", "_s")
    later = 1 if policy == "pessimistic" else 0
    rows = rows.withColumn("_next", F.col("_s.idx") + later).withColumn("_below", F.when(buy, F.col("limit"))).withColumn("_above", F.when(~buy, F.col("limit")))
    rows = first_reached(rows, tables, "_next", "_below", "_above", "_b")
    # Within the bar of the trigger the price comes from the stop, not from the open.
    same = F.col("_b.idx") == F.col("_s.idx")
    passed = F.when(buy, F.greatest("stop", "_b.open")).otherwise(F.least("stop", "_b.open"))
    within = F.when(buy, F.least(F.col("limit"), passed)).otherwise(F.greatest(F.col("limit"), passed))
    price = F.when(same, within).otherwise(_better(F.col("limit"), buy))
    would = F.when(buy, F.col("_s.low") <= F.col("limit")).otherwise(F.col("_s.high") >= F.col("limit"))
    return rows.select(
        *orders.columns, F.col("_s.close_ts").alias("trigger_ts"), F.col("_b.close_ts").alias("fill_ts"), F.when(F.col("_b").isNotNull(), price).alias("price"), (F.coalesce(would, F.lit(False)) & F.lit(later == 1)).alias("deferred")
    )


def fills_in_time(orders: DataFrame, bars: DataFrame, cap: Column, ends: Column) -> DataFrame:
    """Market orders (instrument, active_from, qty and more) of all times in force under a cap of what a bar fills: gtc, day, ioc and fok (what each fills), done_ts (when a
    gtc order is filled; null if the bars end before) and cost (sum of price times quantity of what gtc fills, at the bars' opens).

    The caps are added up along the bars; an order is filled where the sum passes what it stood at before, plus the quantity. ``ends`` is when a day order ends.
    """
    w = _bars.by_time().rowsBetween(Window.unboundedPreceding, 0)
    b = bars.select("instrument", "close_ts", "open", cap.cast("long").alias("cap"))
    sums = b.select("instrument", "close_ts", "open", "cap", F.sum("cap").over(w).alias("sum"), F.sum(F.col("cap") * F.col("open")).over(w).alias("paid"))
    known = lambda name: sums.select("instrument", F.col("close_ts").alias("_t"), *(F.col(c).alias(f"{name}_{c}") for c in ("sum", "paid")))
    rows = orders.withColumn("_ends", ends - 1)
    rows = as_of(rows, known("before"), "instrument", "active_from", "_t", ["before_sum", "before_paid"])
    rows = as_of(rows, known("day"), "instrument", "_ends", "_t", ["day_sum", "day_paid"])
    rows = as_of(rows, known("all").withColumn("_t", F.lit(0).cast("long")).groupBy("instrument", "_t").agg(F.max("all_sum").alias("all_sum"), F.max_by("all_paid", "all_sum").alias("all_paid")), "instrument", "active_from", "_t", ["all_sum", "all_paid"])
    rows = as_of(rows, b.select("instrument", F.col("close_ts").alias("_t"), F.col("cap").alias("first_cap")), "instrument", "active_from", "_t", ["first_cap"], forward=True, strict=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumn("_goal", zero("before_sum") + F.col("qty"))
    full = sums.where("cap > 0").select("instrument", "sum", F.struct("close_ts", "open", "sum", "paid", "cap").alias("_done"))
    rows = as_of(rows, full, "instrument", "_goal", "sum", ["_done"], forward=True)
    done = F.col("_done").isNotNull()
    whole = F.col("_done.paid") - F.col("_done.cap") * F.col("_done.open") + (F.col("_goal") - F.col("_done.sum") + F.col("_done.cap")) * F.col("_done.open") - zero("before_paid")
    return rows.select(
        *orders.columns,
        F.when(done, F.col("qty")).otherwise(zero("all_sum") - zero("before_sum")).alias("gtc"),
        F.least(F.col("qty"), F.greatest(zero("day_sum") - zero("before_sum"), F.lit(0))).alias("day"),
        F.least(F.col("qty"), zero("first_cap")).alias("ioc"),
        F.when(zero("first_cap") >= F.col("qty"), F.col("qty")).otherwise(F.lit(0)).alias("fok"),
        F.col("_done.close_ts").alias("done_ts"),
        F.when(done, whole).otherwise(zero("all_paid") - zero("before_paid")).alias("cost"),
    )
