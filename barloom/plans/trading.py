"""Queries over orders, ledgers, metrics and the native backtest; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import fixed, times
from barloom.operators import bars, ledger, matching, metrics, orders
from barloom.plans.market import BARS, ORDER, TICKS, _rounded
from barloom.plans.registry import query
from barloom.sources import adapters

H = times.HOUR
#: A point of price is worth one unit of money a hundred times over: prices are in cents, money in 10^-8.
POINT, DIVISOR = 1_000_000, 1
_ORDERS = f"""{BARS}, ord AS (SELECT seq AS order_id, instrument, ts_us AS active_from, CASE seq % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS kind, CASE WHEN seq // 3 % 2 = 0 THEN 1 ELSE -1 END AS side,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE price + (seq % 97 - 48) * 20 END AS level FROM ticks)"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """An order of every tick."""
    t, k = adapters.ticks(spark, d), F.col("seq") % 3
    side = F.when(F.call_function("div", F.col("seq"), F.lit(3)) % 2 == 0, 1).otherwise(-1)
    return t.select(
        F.col("seq").alias("order_id"), "instrument", F.col("ts_us").alias("active_from"), F.when(k == 0, "market").when(k == 1, "limit").otherwise("stop").alias("kind"), side.alias("side"), F.when(k != 0, F.col("price") + (F.col("seq") % 97 - 48) * 20).alias("level")
    )


def _touch(kind: str) -> str:
    return f"""WITH {_ORDERS}, nb AS (SELECT *, row_number() {ORDER}) - 1 AS i FROM bars),
    st AS (SELECT o.*, coalesce((SELECT max(i) FROM nb WHERE nb.instrument = o.instrument AND nb.close_ts <= o.active_from), -1) AS seen FROM ord o WHERE kind = '{kind}'),
    hit AS (SELECT s.order_id, b.close_ts AS fill_ts, CASE WHEN (s.kind = 'limit') = (s.side > 0) THEN least(s.level, b.open) ELSE greatest(s.level, b.open) END AS price FROM st s JOIN nb b ON b.instrument = s.instrument AND b.i > s.seen
      WHERE CASE WHEN (s.kind = 'limit') = (s.side > 0) THEN b.low <= s.level ELSE b.high >= s.level END)
    SELECT s.order_id, s.instrument, s.active_from, s.kind, s.side, s.level, x.fill_ts, x.price FROM st s LEFT JOIN (SELECT order_id, min(fill_ts) AS fill_ts, arg_min(price, fill_ts) AS price FROM hit GROUP BY 1) x USING (order_id)"""


@query(f"WITH {_ORDERS} SELECT o.order_id, o.instrument, o.active_from, b.close_ts AS fill_ts, b.open AS price FROM ord o ASOF LEFT JOIN bars b ON o.instrument = b.instrument AND o.active_from < b.close_ts WHERE kind = 'market'")
def market_next_open(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).where("kind = 'market'").select("order_id", "instrument", "active_from")
    return orders.next_open(o, adapters.hourly(spark, d))


@query(_touch("limit"))
def limit_first_touch(spark: SparkSession, d: str) -> DataFrame:
    return matching.first_touch(_orders(spark, d).where("kind = 'limit'"), adapters.hourly(spark, d))


@query(_touch("stop"))
def stop_first_touch(spark: SparkSession, d: str) -> DataFrame:
    return matching.first_touch(_orders(spark, d).where("kind = 'stop'"), adapters.hourly(spark, d))


@query(f"{_touch('limit')[:-len(' USING (order_id)')]} USING (order_id)".replace("x.fill_ts, x.price", f"CASE WHEN x.fill_ts < (s.active_from // {times.DAY} + 1) * {times.DAY} THEN x.fill_ts END AS fill_ts, (x.fill_ts < (s.active_from // {times.DAY} + 1) * {times.DAY}) IS NOT TRUE AS expired"))
def day_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Limit orders for the day: they end at the next midnight, before that bar is matched."""
    o = matching.first_touch(_orders(spark, d).where("kind = 'limit'"), adapters.hourly(spark, d))
    ends = (times.day_index(F.col("active_from")) + 1) * times.DAY
    alive = F.coalesce(F.col("fill_ts") < ends, F.lit(False))
    return o.withColumn("fill_ts", F.when(alive, F.col("fill_ts"))).withColumn("expired", ~alive).drop("price")


_VALID = """v AS (SELECT o_orderkey AS k, CAST(o_custkey % 23 - 2 AS BIGINT) AS qty, ['market', 'limit', 'stop', 'stop_limit'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 5 < 3 THEN CAST(round(o_totalprice * 100) AS BIGINT) // 10 * (o_orderkey % 2 * 9 + 1) END AS lim,
  CASE WHEN o_orderkey % 7 < 4 THEN CAST(round(o_totalprice * 100) AS BIGINT) // 10 * 10 - 3000000 END AS stp FROM orders)"""


@query(
    f"""WITH {_VALID} SELECT k, CASE WHEN qty <= 0 OR qty % 2 <> 0 THEN 'invalid_quantity' WHEN kind IN ('limit', 'stop_limit') AND lim IS NULL OR kind IN ('stop', 'stop_limit') AND stp IS NULL THEN 'missing_price'
    WHEN kind NOT IN ('limit', 'stop_limit') AND lim IS NOT NULL OR kind NOT IN ('stop', 'stop_limit') AND stp IS NOT NULL OR coalesce(lim <= 0 OR lim % 10 <> 0, false) OR coalesce(stp <= 0 OR stp % 10 <> 0, false) THEN 'invalid_price' END AS reason FROM v"""
)
def order_validation(spark: SparkSession, d: str) -> DataFrame:
    o = adapters.table(spark, d, "orders")
    k = F.col("o_orderkey")
    tenth = F.call_function("div", adapters.cents("o_totalprice"), F.lit(10))
    v = o.select(
        k.alias("k"), (F.col("o_custkey") % 23 - 2).alias("qty"), F.element_at(F.array(*(F.lit(x) for x in ("market", "limit", "stop", "stop_limit"))), (k % 4 + 1).cast("int")).alias("kind"),
        F.when(k % 5 < 3, tenth * (k % 2 * 9 + 1)).alias("lim"), F.when(k % 7 < 4, tenth * 10 - 3_000_000).alias("stp"),
    )
    return v.select("k", orders.validation(F.col("qty"), F.col("kind"), F.col("lim"), F.col("stp"), 10, 2).alias("reason"))


_TAKEN = f"{TICKS}, x AS (SELECT seq, price, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side, seq % 3 <> 0 AS taker, size, price % 37 AS rng FROM ticks)"


def _worse(offset: str) -> str:
    raw = f"(price + ({offset}) * side)"
    return f"CASE WHEN NOT taker THEN price WHEN side > 0 THEN {raw} + (5 - {raw} % 5) % 5 ELSE {raw} - ({raw} % 5 + 5) % 5 END"


def _ceil(n: str) -> str:
    return f"(({n}) // 10000 + CASE WHEN ({n}) % 10000 > 0 THEN 1 ELSE 0 END)"


@query(f"WITH {_TAKEN} SELECT seq, price AS none, CASE WHEN taker THEN price + side * 10 ELSE price END AS ticks, {_worse(_ceil('price * 15'))} AS bps, CASE WHEN rng = 0 THEN price ELSE {_worse(_ceil('rng * 2500'))} END AS range FROM x")
def slippage_models(spark: SparkSession, d: str) -> DataFrame:
    x = adapters.ticks(spark, d).select("seq", "price", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("seq") % 3 != 0).alias("taker"), (F.col("price") % 37).alias("rng"))
    paid = lambda m, n: orders.slippage(m, F.col("price"), F.col("side"), F.col("taker"), 5, n, F.col("rng")).alias(m)
    return x.select("seq", paid("none", 0), paid("ticks", 2), paid("bps", 15), paid("range", 2500))


@query(
    f"WITH {_TAKEN}, n AS (SELECT seq, taker, size, price::HUGEINT * size * 1000000 AS notional FROM x) SELECT seq, greatest({_rounded('(notional * CASE WHEN taker THEN 10 ELSE 2 END)', '10000::HUGEINT', 'half-up')}, 500000000) AS bps, "
    f"{_rounded('(notional * CASE WHEN taker THEN 600 ELSE 400 END)', '100000::HUGEINT', 'half-up')} AS spot, CAST(size * 50000000 AS BIGINT) AS per_unit FROM n"
)
def commission_models(spark: SparkSession, d: str) -> DataFrame:
    x = adapters.ticks(spark, d).select("seq", (F.col("seq") % 3 != 0).alias("taker"), "size", fixed.notional(F.col("price"), F.col("size"), POINT, DIVISOR).alias("notional"))
    taker, n = F.col("taker"), F.col("notional")
    return x.select("seq", orders.commission_bps(n, taker, 2, 10, 500_000_000).alias("bps"), orders.commission_spot(n, taker, "coinbase").alias("spot"), orders.commission_per_unit(F.col("size"), 50_000_000).alias("per_unit"))


@query(f"WITH {BARS} SELECT instrument, close_ts, CASE WHEN volume - 100 <= 0 THEN 25 ELSE least(25, (volume - 100) * 1000 // 10000 // 2 * 2) END AS fill_cap FROM bars")
def participation_cap(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", orders.participation(F.col("volume") - 100, F.lit(25).cast("long"), 1000, 2).alias("fill_cap"))


FILLS = """fills AS (SELECT o_orderpriority AS instrument, epoch_us(o_orderdate) AS ts_us, o_orderkey AS seq, 1 - 2 * (o_orderkey % 2) AS side, o_custkey % 20 + 1 AS qty, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders)"""
_LEDGER = f"{FILLS}, led AS (SELECT *, CAST(sum(side * qty) w AS BIGINT) AS position, CAST(sum(-(price * side * qty * {POINT}) - qty * 30000000) w AS BIGINT) AS cash FROM fills WINDOW w AS (PARTITION BY instrument ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING))".replace(" w AS BIGINT", " OVER w AS BIGINT")


@query(f"WITH {_LEDGER} SELECT instrument, seq, position, cash, CAST(cash + position * price * {POINT} AS BIGINT) AS equity FROM led")
def cash_equity(spark: SparkSession, d: str) -> DataFrame:
    led = ledger.running(adapters.fills(spark, d), POINT, DIVISOR, 30_000_000)
    return led.select("instrument", "seq", "position", "cash", (F.col("cash") + F.col("position") * F.col("price") * POINT).alias("equity"))


@query(f"WITH {_LEDGER} SELECT instrument, ts_us // {times.DAY} AS day, arg_max(position, (ts_us, seq)) AS position, max(position) AS most, min(position) AS least FROM led GROUP BY ALL")
def position_running(spark: SparkSession, d: str) -> DataFrame:
    led = ledger.running(adapters.fills(spark, d), POINT, DIVISOR)
    return led.groupBy("instrument", times.day_index(F.col("ts_us")).alias("day")).agg(F.max_by("position", F.struct("ts_us", "seq")).alias("position"), F.max("position").alias("most"), F.min("position").alias("least"))


def _basis(columns: str) -> str:
    cut = "least(f.qty, abs(p.position))"
    same = "(p.position = 0 OR (p.position > 0) = (f.side > 0))"
    released = f"CASE WHEN {cut} = abs(p.position) THEN p.basis ELSE {_rounded(f'(p.basis * {cut})', 'abs(p.position)::HUGEINT', 'half-even')} END"
    return f"""WITH RECURSIVE {FILLS}, num AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_us, seq) AS i FROM fills),
    led(instrument, i, seq, position, basis, closed, realised) AS (SELECT instrument, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::HUGEINT, 0::BIGINT, 0::HUGEINT FROM (SELECT DISTINCT instrument FROM fills)
      UNION ALL SELECT p.instrument, f.i, f.seq, CAST(p.position + f.side * f.qty AS BIGINT),
        CASE WHEN {same} THEN p.basis + f.price::HUGEINT * f.side * f.qty * {POINT} WHEN f.qty > abs(p.position) THEN f.price::HUGEINT * f.side * (f.qty - abs(p.position)) * {POINT} ELSE p.basis - {released} END,
        CASE WHEN {same} THEN 0 ELSE CAST({cut} AS BIGINT) END,
        CASE WHEN {same} THEN 0::HUGEINT ELSE f.price::HUGEINT * {cut} * {POINT} * CASE WHEN p.position > 0 THEN 1 ELSE -1 END - {released} END
      FROM led p JOIN num f ON f.instrument = p.instrument AND f.i = p.i + 1)
    SELECT {columns} FROM led WHERE i > 0"""


@query(_basis("instrument, seq, position, CAST(basis AS BIGINT) AS basis, closed"))
def cost_basis(spark: SparkSession, d: str) -> DataFrame:
    return ledger.cost_basis(adapters.fills(spark, d), POINT, DIVISOR).select("instrument", "seq", "position", "basis", "closed")


@query(_basis("instrument, CAST(sum(realised) AS BIGINT) AS realised, CAST(sum(closed) AS BIGINT) AS closed") + " GROUP BY instrument")
def realized_pnl(spark: SparkSession, d: str) -> DataFrame:
    return ledger.cost_basis(adapters.fills(spark, d), POINT, DIVISOR).groupBy("instrument").agg(F.sum("realised").alias("realised"), F.sum("closed").alias("closed"))


_TRADES = f"""{_LEDGER}, st AS (SELECT *, position - side * qty AS before FROM led), en AS (SELECT *, before <> 0 AND (position = 0 OR sign(position) <> sign(before)) AS ends FROM st),
  nr AS (SELECT *, CAST(coalesce(sum(ends::INT) OVER (PARTITION BY instrument ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 1 AS trade FROM en),
  pt AS (SELECT instrument, ts_us, seq, side, price, trade, CASE WHEN ends THEN abs(before) ELSE qty END AS q, ends FROM nr UNION ALL SELECT instrument, ts_us, seq, side, price, trade + 1, abs(position), false FROM nr WHERE ends AND position <> 0),
  tr AS (SELECT instrument, trade, arg_min(side, (ts_us, seq)) AS direction, min(ts_us) AS entry_ts, max(ts_us) AS exit_ts, count(*) AS fills, CAST(-sum(price * side * q * {POINT}) AS BIGINT) AS gross, bool_or(ends) AS closed FROM pt GROUP BY ALL)"""


@query(f"WITH {_TRADES} SELECT instrument, trade, direction, entry_ts, exit_ts, fills, gross FROM tr WHERE closed")
def trades_islands(spark: SparkSession, d: str) -> DataFrame:
    return ledger.trades(adapters.fills(spark, d), POINT, DIVISOR)


@query(f"WITH {_LEDGER} SELECT instrument, seq, CAST(abs(position) * 100000000000 AS BIGINT) AS margin FROM led")
def margin_used(spark: SparkSession, d: str) -> DataFrame:
    led = ledger.running(adapters.fills(spark, d), POINT, DIVISOR)
    return led.select("instrument", "seq", fixed.mul_div(F.abs("position"), 100_000_000_000, 1, "half-up").alias("margin"))


# Equity of one run for each instrument: a start that keeps it positive, and the running sum of a signed share of the trades.
_EQUITY = f"{FILLS}, equity AS (SELECT instrument AS run, ts_us AS ts, CAST(1000000000 + sum((price % 2001 - 1000) * 3000) OVER (PARTITION BY instrument ORDER BY ts_us) AS BIGINT) AS equity FROM (SELECT instrument, ts_us, arg_max(price, seq) AS price FROM fills GROUP BY 1, 2))"


def _equity(spark: SparkSession, d: str) -> DataFrame:
    f = adapters.fills(spark, d).groupBy("instrument", "ts_us").agg(F.max_by("price", "seq").alias("price"))
    w = Window.partitionBy("instrument").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)
    return f.select(F.col("instrument").alias("run"), F.col("ts_us").alias("ts"), (F.lit(1_000_000_000) + F.sum((F.col("price") % 2001 - 1000) * 3000).over(w)).alias("equity"))


_W = "OVER (PARTITION BY run ORDER BY ts"
_RET = f"{_EQUITY}, lg AS (SELECT *, lag(equity) {_W}) AS prev FROM equity), lw AS (SELECT *, min(prev) {_W} ROWS UNBOUNDED PRECEDING) AS low FROM lg), ret AS (SELECT run, ts, equity / prev - 1 AS r FROM lw WHERE prev IS NOT NULL AND low > 0)"
_UNDER = f"{_EQUITY}, pk AS (SELECT run, ts, equity, max(equity) {_W} ROWS UNBOUNDED PRECEDING) AS peak FROM equity), und AS (SELECT run, ts, peak, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS depth FROM pk)"


@query(f"WITH {_RET} SELECT run, ts, round(r, 6) AS r FROM ret")
def returns(spark: SparkSession, d: str) -> DataFrame:
    return metrics.returns(_equity(spark, d)).withColumn("r", F.round("r", 6))


@query(f"WITH {_UNDER} SELECT run, ts, peak, round(depth, 6) AS depth FROM und")
def underwater(spark: SparkSession, d: str) -> DataFrame:
    return metrics.underwater(_equity(spark, d)).withColumn("depth", F.round("depth", 6))


@query(
    f"""WITH {_EQUITY}, n AS (SELECT *, row_number() {_W}) AS i, count(*) OVER (PARTITION BY run) AS n, coalesce(equity >= max(equity) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top FROM equity),
    s AS (SELECT *, sum(top::INT) {_W} ROWS UNBOUNDED PRECEDING) AS island FROM n),
    e AS (SELECT run, island, min(ts) AS peak_ts, arg_min(equity, ts) AS peak, min(equity) AS low, arg_min(ts, (equity, ts)) AS trough_ts, min(i) AS f, max(i) AS l, max(n) AS n FROM s GROUP BY 1, 2)
    SELECT e.run, peak_ts, trough_ts, t.ts AS recovered_ts, round(CASE WHEN peak > 0 THEN (peak - low) / peak ELSE 0 END, 6) AS depth, peak - low AS depth_money, CASE WHEN t.ts IS NULL THEN e.n ELSE l + 1 END - f AS bars
    FROM e LEFT JOIN s t ON t.run = e.run AND t.top AND t.island = e.island + 1 WHERE l > f"""
)
def drawdown_episodes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.drawdowns(_equity(spark, d)).withColumn("depth", F.round("depth", 6))


_PPY = f"{_RET}, gp AS (SELECT run, median(g) AS g, count(*) + 1 AS n FROM (SELECT run, ts - lag(ts) {_W}) AS g FROM equity) WHERE g IS NOT NULL GROUP BY 1), pp AS (SELECT run, CASE WHEN n >= 3 THEN {metrics.YEAR} / g ELSE 0 END AS ppy FROM gp)"


@query(
    f"""WITH {_PPY}, a AS (SELECT run, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(pow(least(r, 0), 2))) AS dn, max(ppy) AS ppy FROM ret JOIN pp USING (run) GROUP BY 1)
    SELECT run, n AS n_returns, round(CASE WHEN n >= 30 THEN s * sqrt(ppy) END, 4) AS volatility, round(CASE WHEN n >= 30 AND s > 0 THEN m / s * sqrt(ppy) END, 4) AS sharpe, round(CASE WHEN n >= 30 AND dn > 0 THEN m / dn * sqrt(ppy) END, 4) AS sortino FROM a"""
)
def volatility_sharpe_sortino(spark: SparkSession, d: str) -> DataFrame:
    return metrics.risk(_equity(spark, d)).select("run", "n_returns", *(F.round(c, 4).alias(c) for c in ("volatility", "sharpe", "sortino")))


@query(
    f"""WITH {_UNDER}, e AS (SELECT run, arg_min(equity, ts) AS a, arg_max(equity, ts) AS z, max(ts) - min(ts) AS span FROM equity GROUP BY 1), m AS (SELECT run, max(depth) AS dd FROM und GROUP BY 1),
    c AS (SELECT run, CASE WHEN a > 0 THEN z / a - 1 END AS t, CASE WHEN span >= {metrics.LEAST_SPAN} AND a > 0 AND z > 0 THEN pow(z / a, {metrics.YEAR} / span) - 1 END AS cagr, dd FROM e JOIN m USING (run))
    SELECT run, round(t, 6) AS total_return, round(cagr, 6) AS cagr, round(dd, 6) AS max_drawdown, round(CASE WHEN dd > 0 THEN cagr / dd END, 4) AS calmar FROM c"""
)
def cagr_calmar(spark: SparkSession, d: str) -> DataFrame:
    return metrics.growth(_equity(spark, d)).select("run", *(F.round(c, 6).alias(c) for c in ("total_return", "cagr", "max_drawdown")), F.round("calmar", 4).alias("calmar"))


_STAT = f"{_TRADES}, t AS (SELECT instrument AS run, gross, gross - fills * 5000000000 AS net, fills AS bars FROM tr WHERE closed)"


def _stat_trades(spark: SparkSession, d: str) -> DataFrame:
    return ledger.trades(adapters.fills(spark, d), POINT, DIVISOR).select(F.col("instrument").alias("run"), "gross", (F.col("gross") - F.col("fills") * 5_000_000_000).alias("net"), F.col("fills").alias("bars"))


@query(
    f"""WITH {_STAT}, a AS (SELECT run, count(*) AS trades, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, CAST(coalesce(sum(net) FILTER (net > 0), 0) AS BIGINT) AS gross_profit, CAST(coalesce(-sum(net) FILTER (net < 0), 0) AS BIGINT) AS gross_loss,
    CAST(sum(net) AS BIGINT) AS net, coalesce(max(net) FILTER (net > 0), 0) AS largest_win, coalesce(max(-net) FILTER (net < 0), 0) AS largest_loss, CAST(sum(gross) AS BIGINT) AS pre_cost, round(avg(bars), 4) AS avg_bars FROM t GROUP BY 1)
    SELECT run, trades, wins, losses, gross_profit, gross_loss, largest_win, largest_loss, pre_cost, avg_bars, round(wins / trades, 6) AS win_rate, round(CASE WHEN gross_loss <> 0 THEN gross_profit / gross_loss END, 6) AS profit_factor,
    CAST(floor(net / trades + 0.5) AS BIGINT) AS expectancy, CASE WHEN wins = 0 THEN 0 ELSE CAST(floor(gross_profit / wins + 0.5) AS BIGINT) END AS avg_win, CASE WHEN losses = 0 THEN 0 ELSE CAST(floor(gross_loss / losses + 0.5) AS BIGINT) END AS avg_loss FROM a"""
)
def trade_stats(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.trade_stats(_stat_trades(spark, d))
    return s.withColumn("avg_bars", F.round("avg_bars", 4)).withColumn("win_rate", F.round("win_rate", 6)).withColumn("profit_factor", F.round("profit_factor", 6))


@query(
    f"""WITH {_STAT}, u AS (SELECT instrument AS run, CAST(sum(qty) AS BIGINT) AS units FROM fills GROUP BY 1), g AS (SELECT run, CAST(sum(gross) AS BIGINT) AS pre, CAST(sum(bars) * 5000000000 AS BIGINT) AS com FROM t GROUP BY 1)
    SELECT run, units, {_rounded('com::HUGEINT', 'units::HUGEINT', 'half-up')} AS commission_per_unit, CASE WHEN units > 0 AND pre > 0 THEN pre // units END AS break_even FROM u JOIN g USING (run)"""
)
def break_even(spark: SparkSession, d: str) -> DataFrame:
    units = adapters.fills(spark, d).groupBy(F.col("instrument").alias("run")).agg(F.sum("qty").alias("units"))
    g = _stat_trades(spark, d).groupBy("run").agg(F.sum("gross").alias("pre"), (F.sum("bars") * 5_000_000_000).alias("com"))
    per, even = metrics.break_even(F.col("units"), F.col("pre"), F.col("com"), 1)
    return units.join(g, "run").select("run", "units", per.alias("commission_per_unit"), even.alias("break_even"))


@query(
    f"""WITH {_RET}, e AS (SELECT run, min(r) AS a, max(r) AS z FROM ret GROUP BY 1), w AS (SELECT run, CASE WHEN a = z THEN a - 1 ELSE a END AS a, CASE WHEN a = z THEN z + 1 ELSE z END AS z FROM e)
    SELECT run, least(30, CAST(floor((r - a) / ((z - a) / 31)) AS INTEGER)) AS bin, count(*) AS n FROM ret JOIN w USING (run) GROUP BY ALL"""
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(metrics.returns(_equity(spark, d)), "r", 31)


@query(
    f"""WITH {_EQUITY}, n AS (SELECT *, row_number() {_W}) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM equity), b AS (SELECT *, CASE WHEN n <= 120 THEN i ELSE ((i + 1) * 60 - 1) // n END AS bucket FROM n),
    m AS (SELECT run, bucket, arg_min(ts, (equity, i)) AS lt, min(equity) AS le, arg_max(ts, (equity, -i)) AS ht, max(equity) AS he FROM b GROUP BY 1, 2) SELECT run, lt AS ts, le AS equity FROM m UNION SELECT run, ht, he FROM m"""
)
def downsample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.downsample(_equity(spark, d), "equity", 60)


def _cross(fast: int, slow: int, qty: int, fee_bps: int, slip_bps: int, where: str = "") -> str:
    """The crossover backtest in SQL: position after the fill at each bar's open, cash and equity at its close."""
    w = lambda n: f"{ORDER} ROWS {n - 1} PRECEDING)"
    price = f"(open + sgn * {_ceil(f'open * {slip_bps}')})" if slip_bps else "open"
    fee = _rounded(f"(abs({price} * delta)::HUGEINT * {POINT} * {fee_bps})", "10000::HUGEINT", "half-up") if fee_bps else "0"
    return f"""{BARS}, s1 AS (SELECT *, CASE WHEN count(*) {w(slow)} = {slow} THEN sign(sum(close) {w(fast)} * {slow} - sum(close) {w(slow)} * {fast}) END AS s FROM bars {where}),
    s2 AS (SELECT *, last_value(nullif(s, 0) IGNORE NULLS) {ORDER} ROWS UNBOUNDED PRECEDING) AS held FROM s1), s3 AS (SELECT *, CASE WHEN held > 0 THEN {qty} WHEN held < 0 THEN -{qty} ELSE 0 END AS target FROM s2),
    s4 AS (SELECT *, coalesce(lag(target) {ORDER}), 0) AS position, coalesce(lag(target) {ORDER}), 0) - coalesce(lag(target, 2) {ORDER}), 0) AS delta FROM s3), s5 AS (SELECT *, sign(delta) AS sgn FROM s4),
    s6 AS (SELECT *, {price} AS price, CAST({fee} AS BIGINT) AS fee FROM s5),
    run AS (SELECT instrument, close_ts, target, position, delta, CASE WHEN delta <> 0 THEN CAST(price AS BIGINT) END AS fill_price, fee AS commission, CAST(100000000000000 + sum(-(price * delta * {POINT}) - fee) {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cash,
      CAST(100000000000000 + sum(-(price * delta * {POINT}) - fee) {ORDER} ROWS UNBOUNDED PRECEDING) + position * close * {POINT} AS BIGINT) AS equity FROM s6)"""


def crossover(b: DataFrame, fast: int, slow: int, qty: int, fee_bps: int = 0, slip_bps: int = 0) -> DataFrame:
    """The crossover strategy with market orders: what a bar decides fills at the next bar's open. Exact where liquidity has no limit and latency is below a bar."""
    w = bars.by_time()
    rows = orders.crossover_targets(b, fast, slow, qty)
    before = F.coalesce(F.lag("target").over(w), F.lit(0))
    rows = rows.withColumn("position", before).withColumn("delta", before - F.coalesce(F.lag("target", 2).over(w), F.lit(0)))
    rows = rows.withColumn("price", orders.slippage("bps" if slip_bps else "none", F.col("open"), F.signum("delta").cast("int"), F.lit(True), 1, slip_bps))
    fee = orders.commission_bps(fixed.notional(F.col("price"), F.col("delta"), POINT, DIVISOR), F.lit(True), fee_bps, fee_bps) if fee_bps else F.lit(0)
    rows = rows.withColumn("price", F.when(F.col("delta") != 0, F.col("price")).otherwise(F.col("open"))).withColumn("commission", fee.cast("long"))
    flow = F.sum(-(F.col("price") * F.col("delta") * POINT) - F.col("commission")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("cash", F.lit(100_000_000_000_000) + flow)
    return rows.select("instrument", "close_ts", "target", "position", "delta", F.when(F.col("delta") != 0, F.col("price")).alias("fill_price"), "commission", "cash", (F.col("cash") + F.col("position") * F.col("close") * POINT).alias("equity"))


@query(f"WITH {_cross(8, 24, 10, 10, 15)} SELECT * FROM run")
def sma_crossover(spark: SparkSession, d: str) -> DataFrame:
    return crossover(adapters.hourly(spark, d), 8, 24, 10, 10, 15)


@query(
    f"""WITH a AS (WITH {_cross(8, 24, 10, 10, 15)} SELECT * FROM run), b AS (WITH {_cross(8, 24, 10, 60, 15)} SELECT * FROM run), u AS (SELECT 'low' AS venue, * FROM a UNION ALL SELECT 'high', * FROM b)
    SELECT venue, instrument, count(*) FILTER (delta <> 0) AS fills, CAST(sum(commission) AS BIGINT) AS commission, arg_max(equity, close_ts) AS final_equity FROM u GROUP BY 1, 2"""
)
def venue_compare(spark: SparkSession, d: str) -> DataFrame:
    """The same strategy under the fees of two venues."""
    b = adapters.hourly(spark, d)
    both = crossover(b, 8, 24, 10, 10, 15).withColumn("venue", F.lit("low")).unionByName(crossover(b, 8, 24, 10, 60, 15).withColumn("venue", F.lit("high")))
    return both.groupBy("venue", "instrument").agg(F.count_if(F.col("delta") != 0).alias("fills"), F.sum("commission").alias("commission"), F.max_by("equity", "close_ts").alias("final_equity"))


@query(
    f"""WITH {_cross(8, 24, 10, 10, 15)}, m AS (SELECT *, CAST(sum(CASE WHEN delta <> 0 THEN 1 ELSE 0 END) {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trade, max(fill_price) OVER () AS _ FROM run),
    e AS (SELECT m.*, max(fill_price) OVER (PARTITION BY m.instrument, trade) AS entry, close FROM m JOIN bars USING (instrument, close_ts) WHERE position <> 0)
    SELECT instrument, trade, CAST(min((close - entry) * position * {POINT}) AS BIGINT) AS mae, CAST(max((close - entry) * position * {POINT}) AS BIGINT) AS mfe, count(*) AS bars_held FROM e GROUP BY 1, 2"""
)
def mae_mfe(spark: SparkSession, d: str) -> DataFrame:
    """Worst and best unrealised result of each trade at its bars' closes, and the number of bars."""
    b = adapters.hourly(spark, d)
    run = crossover(b, 8, 24, 10, 10, 15).withColumn("trade", F.sum(F.when(F.col("delta") != 0, 1).otherwise(0)).over(bars.by_time().rowsBetween(Window.unboundedPreceding, 0)))
    held = run.where("position <> 0").join(b.select("instrument", "close_ts", "close"), ["instrument", "close_ts"])
    held = held.withColumn("entry", F.max("fill_price").over(Window.partitionBy("instrument", "trade")))
    open_ = (F.col("close") - F.col("entry")) * F.col("position") * POINT
    return held.groupBy("instrument", "trade").agg(F.min(open_).alias("mae"), F.max(open_).alias("mfe"), F.count("*").alias("bars_held"))


@query(
    f"WITH {_TAKEN}, n AS (SELECT seq, taker, size, price::HUGEINT * size * 1000000 AS notional FROM x) SELECT seq, greatest({_rounded('(notional * CASE WHEN taker THEN 75000 ELSE 20000 END)', '100000000::HUGEINT', 'half-up')}, 10000000) AS percent, CAST(size * 19500000 AS BIGINT) AS index_day_trade, CAST(size * (64800000 + 25000000) AS BIGINT) AS dollar FROM n"
)
def commission_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Commissions in percent, and by the exchange's tariff: the index for day trades, the dollar at 5.40 with a broker's charge."""
    x = adapters.ticks(spark, d).select("seq", (F.col("seq") % 3 != 0).alias("taker"), "size", fixed.notional(F.col("price"), F.col("size"), POINT, DIVISOR).alias("notional"))
    return x.select(
        "seq", orders.commission_percent(F.col("notional"), F.col("taker"), "0.020", "0.075", "0.1").alias("percent"), orders.commission_tariff(F.col("size"), "WIN", day_trade=True).alias("index_day_trade"), orders.commission_tariff(F.col("size"), "WDO", usd_brl="5.40", brokerage="0.25").alias("dollar")
    )


@query(f"WITH {TICKS} SELECT seq, CASE WHEN price > 0 THEN greatest(((size * 100000000000) // (price * {POINT})) // 3 * 3, 0) END AS qty FROM ticks")
def qty_from_notional(spark: SparkSession, d: str) -> DataFrame:
    """The most whole lots of three that a sum of money buys."""
    t = adapters.ticks(spark, d)
    return t.select("seq", F.when(F.col("price") > 0, orders.qty_from_notional(F.col("size") * 100_000_000_000, F.when(F.col("price") > 0, F.col("price")), POINT, DIVISOR, 3)).alias("qty"))
