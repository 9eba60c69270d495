"""Queries over market data: scans, bars, fixed point, indicators, joins in time; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import fixed, times
from barloom.operators import bars, indicators, lookups
from barloom.plans.registry import query
from barloom.sources import adapters

H = times.HOUR
TICKS = """ticks AS (SELECT event_type AS instrument, epoch_us(ts) AS ts_us, CAST(round(value * 100) AS BIGINT) AS price, CAST(event_id % 100 + 1 AS BIGINT) AS size,
  CAST(event_id % 3 AS INTEGER) - 1 AS aggressor, event_id AS seq FROM events)"""
BARS = f"""{TICKS}, bars AS (SELECT instrument, (ts_us // {H}) * {H} AS open_ts, (ts_us // {H}) * {H} + {H} AS close_ts, arg_min(price, (ts_us, seq)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (ts_us, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY ALL)"""
ORDER = "OVER (PARTITION BY instrument ORDER BY close_ts"


def _r(c, digits: int = 4):
    return F.round(c, digits)


@query(f"WITH {TICKS} SELECT *, CASE aggressor WHEN 1 THEN 'buy' WHEN -1 THEN 'sell' END AS side FROM ticks")
def ticks_scan(spark: SparkSession, d: str) -> DataFrame:
    return adapters.ticks(spark, d).withColumn("side", F.when(F.col("aggressor") == 1, "buy").when(F.col("aggressor") == -1, "sell"))


@query(f"WITH {TICKS} SELECT instrument, count(*) AS n, min(ts_us) AS first_ts, max(ts_us) AS last_ts, count(*) FILTER (price <= 0 OR size <= 0) AS bad, count(*) - count(DISTINCT ts_us) AS repeated FROM ticks GROUP BY 1")
def tick_validation(spark: SparkSession, d: str) -> DataFrame:
    t = adapters.ticks(spark, d)
    return t.groupBy("instrument").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"), F.count_if((F.col("price") <= 0) | (F.col("size") <= 0)).alias("bad"), (F.count("*") - F.countDistinct("ts_us")).alias("repeated")
    )


@query(f"WITH {BARS} SELECT * FROM bars")
def bars_1h(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d)


def _resampled(size: int) -> str:
    return f"""WITH {BARS}, r AS (SELECT instrument, (open_ts // {size}) * {size} AS open_ts, max(close_ts) AS close_ts, arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, open_ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM bars GROUP BY instrument, (open_ts // {size})),
      m AS (SELECT *, open_ts = max(open_ts) OVER (PARTITION BY instrument) AND close_ts < open_ts + {size} AS dropped FROM r)"""


@query(_resampled(4 * H) + " SELECT instrument, open_ts, close_ts, open, high, low, close, volume, n FROM m WHERE NOT dropped")
def resample_4h(spark: SparkSession, d: str) -> DataFrame:
    return bars.resample(adapters.hourly(spark, d), 4 * H, H).where("not dropped").select("instrument", "open_ts", "close_ts", *bars.OHLCV, "n")


@query(_resampled(24 * H) + " SELECT instrument, count(*) FILTER (n < 24 AND NOT dropped) AS partial_buckets, CAST(coalesce(sum(n) FILTER (dropped), 0) AS BIGINT) AS dropped_trailing_bars, count(*) FILTER (NOT dropped) AS bars FROM m GROUP BY 1")
def resample_1d_partial(spark: SparkSession, d: str) -> DataFrame:
    r = bars.resample(adapters.hourly(spark, d), 24 * H, H)
    return r.groupBy("instrument").agg(F.count_if((F.col("n") < 24) & ~F.col("dropped")).alias("partial_buckets"), F.coalesce(F.sum(F.when(F.col("dropped"), F.col("n"))), F.lit(0)).alias("dropped_trailing_bars"), F.count_if(~F.col("dropped")).alias("bars"))


@query(_resampled(168 * H) + " SELECT instrument, open_ts, n FROM m WHERE dropped")
def dropped_trailing(spark: SparkSession, d: str) -> DataFrame:
    return bars.resample(adapters.hourly(spark, d), 168 * H, H).where("dropped").select("instrument", "open_ts", "n")


# Every seventh bar is damaged in one of several ways, so that each rule has work.
_DAMAGED = f"""{BARS}, dam AS (SELECT instrument, CASE WHEN open_ts // {H} % 35 = 28 THEN open_ts - {H} * 500 ELSE open_ts END AS open_ts, close_ts, CASE WHEN open_ts // {H} % 35 = 7 THEN high + 1 ELSE open END AS open,
  CASE WHEN open_ts // {H} % 35 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN open_ts // {H} % 35 = 14 THEN low - 1 ELSE close END AS close, CASE WHEN open_ts // {H} % 35 = 21 THEN -volume ELSE volume END AS volume FROM bars)"""


@query(
    f"""WITH {_DAMAGED} SELECT *, CASE WHEN high < low THEN 'range' WHEN NOT open BETWEEN low AND high THEN 'open' WHEN NOT close BETWEEN low AND high THEN 'close' WHEN volume < 0 THEN 'volume'
    WHEN close_ts <= open_ts THEN 'times' WHEN open_ts < lag(close_ts) {ORDER}) THEN 'overlap' END AS violation FROM dam"""
)
def bar_violations(spark: SparkSession, d: str) -> DataFrame:
    b = adapters.hourly(spark, d)
    k = F.call_function("div", F.col("open_ts"), F.lit(H)) % 35
    damaged = b.select(
        "instrument",
        F.when(k == 28, F.col("open_ts") - H * 500).otherwise(F.col("open_ts")).alias("open_ts"),
        "close_ts",
        F.when(k == 7, F.col("high") + 1).otherwise(F.col("open")).alias("open"),
        F.when(k == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(k == 14, F.col("low") - 1).otherwise(F.col("close")).alias("close"),
        F.when(k == 21, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )
    return bars.violations(damaged)


@query(f"WITH {BARS} SELECT instrument, close_ts, open, high, low, close, round((high + low) / 2, 4) AS hl2, round((high + low + close) / 3, 4) AS hlc3, round((open + high + low + close) / 4, 4) AS ohlc4 FROM bars")
def price_sources(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", *(_r(bars.price(s)).alias(s) if s.startswith(("hl", "ohlc")) else bars.price(s).alias(s) for s in bars.SOURCES))


@query(f"WITH {BARS}, g AS (SELECT instrument, lag(close_ts) {ORDER}) AS gap_from, open_ts AS gap_to FROM bars) SELECT * FROM g WHERE gap_from < gap_to")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    return bars.gaps(adapters.hourly(spark, d))


def _rounded(n: str, k: str, mode: str) -> str:
    q, r = f"({n} // {k})", f"({n} % {k})"
    away = f"{q} + CASE WHEN {n} < 0 THEN -1 ELSE 1 END"
    rule = {"trunc": "false", "floor": f"{r} <> 0 AND {n} < 0", "ceil": f"{r} <> 0 AND {n} > 0", "half-up": f"abs({r}) * 2 >= {k}", "half-even": f"abs({r}) * 2 > {k} OR abs({r}) * 2 = {k} AND {q} % 2 <> 0"}[mode]
    return f"CAST(CASE WHEN {rule} THEN {away} ELSE {q} END AS BIGINT)"


@query(
    "WITH x AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT)::HUGEINT * (o_custkey % 41 - 20) AS n, (o_orderkey % 8 + 1)::HUGEINT AS v FROM orders) SELECT k, "
    + ", ".join(f"{_rounded('n', 'v', m)} AS {m.replace('-', '_')}" for m in fixed.MODES)
    + " FROM x"
)
def mul_div_modes(spark: SparkSession, d: str) -> DataFrame:
    o = adapters.table(spark, d, "orders")
    a, b, c = adapters.cents("o_totalprice"), F.col("o_custkey") % 41 - 20, F.col("o_orderkey") % 8 + 1
    return o.select(F.col("o_orderkey").alias("k"), *(fixed.mul_div(a, b, c, m).alias(m.replace("-", "_")) for m in fixed.MODES))


@query(f"SELECT o_orderkey AS k, {_rounded('(CAST(round(o_totalprice * 100) AS BIGINT)::HUGEINT * (o_custkey % 20 + 1) * 20000000)', '100::HUGEINT', 'half-up')} AS notional FROM orders")
def notional(spark: SparkSession, d: str) -> DataFrame:
    o = adapters.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), fixed.notional(adapters.cents("o_totalprice"), F.col("o_custkey") % 20 + 1, 20_000_000, 100).alias("notional"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) - 25000000 AS v FROM orders), y AS (SELECT *, ((v % 25) + 25) % 25 AS r FROM x)
    SELECT k, v - r AS down, CASE WHEN r = 0 THEN v ELSE v - r + 25 END AS up, CASE WHEN 2 * r >= 25 THEN v - r + 25 ELSE v - r END AS nearest, CASE WHEN v >= 0 OR r = 0 THEN v - r ELSE v - r + 25 END AS toward_zero, r = 0 AS aligned FROM y"""
)
def round_to_tick(spark: SparkSession, d: str) -> DataFrame:
    o = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (adapters.cents("o_totalprice") - 25_000_000).alias("v"))
    return o.select("k", *(fixed.round_to_tick(F.col("v"), 25, m).alias(m.replace("-", "_")) for m in ("down", "up", "nearest", "toward-zero")), fixed.is_tick_aligned(F.col("v"), 25).alias("aligned"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END AS s FROM orders)
    SELECT k, CAST(CASE WHEN s = '-' THEN -1 ELSE 1 END * ((c // 10) + CASE WHEN c % 10 >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS parsed1, CAST(CASE WHEN s = '-' THEN -1 ELSE 1 END * c * 1000000 AS BIGINT) AS parsed8,
    s || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS text FROM x"""
)
def parse_format_fixed(spark: SparkSession, d: str) -> DataFrame:
    o = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (adapters.cents("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)).alias("c"))
    text = o.withColumn("text", fixed.format_fixed(F.col("c"), 2))
    return text.select("k", fixed.parse_fixed(F.col("text"), 1).alias("parsed1"), fixed.parse_fixed(F.col("text"), 8).alias("parsed8"), "text")


def _when(n: int, x: str) -> str:
    w = f"{ORDER} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(*) {w} = {n} THEN {x} {w} END"


@query(f"WITH {BARS} SELECT instrument, close_ts, round({_when(20, 'avg(close)')}, 4) AS sma20, round({_when(5, 'avg((high + low) / 2)')}, 4) AS sma5_hl2 FROM bars")
def sma(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", _r(indicators.sma(20)).alias("sma20"), _r(indicators.sma(5, "hl2")).alias("sma5_hl2"))


@query(f"WITH {BARS} SELECT instrument, close_ts, round({_when(14, 'avg(close)')}, 4) AS mean, round({_when(14, 'var_pop(close)')}, 4) AS variance, round({_when(14, 'stddev_pop(close)')}, 4) AS std_dev FROM bars")
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", *(_r(c).alias(n) for n, c in indicators.rolling_stats(14).items()))


@query(
    f"""WITH {BARS}, s AS (SELECT instrument, close_ts, {_when(20, 'avg(close)')} AS m, {_when(20, 'stddev_pop(close)')} AS sd FROM bars)
    SELECT instrument, close_ts, round(m, 4) AS middle, round(m + 2 * sd, 4) AS upper, round(m - 2 * sd, 4) AS lower, round(CASE WHEN m = 0 THEN 0 ELSE 4 * sd / m END, 4) AS bandwidth FROM s"""
)
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", *(_r(c).alias(n) for n, c in indicators.bollinger(20, 2.0).items()))


def _vwap(part: str) -> str:
    w = f"OVER (PARTITION BY instrument{part} ORDER BY close_ts ROWS UNBOUNDED PRECEDING)"
    return f"WITH {BARS} SELECT instrument, close_ts, round(sum((high + low + close) / 3 * volume) {w} / nullif(sum(volume) {w}, 0), 4) AS vwap FROM bars"


@query(_vwap(f", close_ts // {times.DAY}"))
def vwap_day(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", _r(indicators.vwap("day")).alias("vwap"))


@query(_vwap(""))
def vwap_never(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", _r(indicators.vwap("never")).alias("vwap"))


_PREV = f"{ORDER} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)"


@query(f"WITH {BARS} SELECT instrument, close_ts, CASE WHEN count(*) {_PREV} = 48 THEN max(high) {_PREV} END AS highest, CASE WHEN count(*) {_PREV} = 48 THEN min(low) {_PREV} END AS lowest, round(CASE WHEN count(*) {_PREV} = 48 THEN avg(volume) {_PREV} END, 4) AS mean_volume FROM bars")
def channel_high(spark: SparkSession, d: str) -> DataFrame:
    c = indicators.channel(48)
    return adapters.hourly(spark, d).select("instrument", "close_ts", c["highest"].alias("highest"), c["lowest"].alias("lowest"), _r(c["mean_volume"]).alias("mean_volume"))


_TR = f"greatest(high - low, coalesce(abs(high - lag(close) {ORDER})), 0), coalesce(abs(low - lag(close) {ORDER})), 0))"


@query(f"WITH {BARS} SELECT instrument, close_ts, {_TR} AS tr FROM bars")
def true_range(spark: SparkSession, d: str) -> DataFrame:
    return adapters.hourly(spark, d).select("instrument", "close_ts", indicators.true_range().alias("tr"))


def _smooth(name: str, source: str, x: str, n: int, alpha: str) -> str:
    """CTEs for a smoothed series of x over source(instrument, i, x), i from 0 on among defined values."""
    return f"""{name}_s AS (SELECT instrument, close_ts, {x} AS x, row_number() OVER (PARTITION BY instrument ORDER BY close_ts) - 1 AS i FROM {source} WHERE {x} IS NOT NULL),
    {name}(instrument, close_ts, i, v) AS (SELECT a.instrument, a.close_ts, a.i, (SELECT avg(x::DOUBLE) FROM {name}_s b WHERE b.instrument = a.instrument AND b.i < {n}) FROM {name}_s a WHERE a.i = {n - 1}
      UNION ALL SELECT s.instrument, s.close_ts, s.i, e.v + {alpha} * (s.x - e.v) FROM {name} e JOIN {name}_s s ON s.instrument = e.instrument AND s.i = e.i + 1)"""


@query(f"WITH RECURSIVE {BARS}, {_smooth('e', 'bars', 'close', 20, '2.0::DOUBLE / 21')} SELECT b.instrument, b.close_ts, round(v, 4) AS ema FROM bars b LEFT JOIN e USING (instrument, close_ts)")
def ema(spark: SparkSession, d: str) -> DataFrame:
    return indicators.ema(adapters.hourly(spark, d), 20).select("instrument", "close_ts", _r("ema").alias("ema"))


@query(f"WITH RECURSIVE {BARS}, {_smooth('e', 'bars', 'close', 14, '1.0::DOUBLE / 14')} SELECT b.instrument, b.close_ts, round(v, 4) AS rma FROM bars b LEFT JOIN e USING (instrument, close_ts)")
def rma(spark: SparkSession, d: str) -> DataFrame:
    return indicators.rma(adapters.hourly(spark, d), 14).select("instrument", "close_ts", _r("rma").alias("rma"))


@query(
    f"""WITH RECURSIVE {BARS}, ch AS (SELECT instrument, close_ts, close - lag(close) {ORDER}) AS c FROM bars), {_smooth('g', 'ch', 'greatest(c, 0) + c * 0', 14, '1.0::DOUBLE / 14')}, {_smooth('l', 'ch', 'greatest(-c, 0) + c * 0', 14, '1.0::DOUBLE / 14')}
    SELECT b.instrument, b.close_ts, round(CASE WHEN l.v = 0 THEN CASE WHEN g.v = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g.v / l.v) END, 4) AS rsi FROM bars b LEFT JOIN g USING (instrument, close_ts) LEFT JOIN l USING (instrument, close_ts)"""
)
def rsi(spark: SparkSession, d: str) -> DataFrame:
    return indicators.rsi(adapters.hourly(spark, d), 14).select("instrument", "close_ts", _r("rsi").alias("rsi"))


@query(f"WITH RECURSIVE {BARS}, t AS (SELECT instrument, close_ts, {_TR} AS tr FROM bars), {_smooth('e', 't', 'tr', 14, '1.0::DOUBLE / 14')} SELECT b.instrument, b.close_ts, round(v, 4) AS atr FROM bars b LEFT JOIN e USING (instrument, close_ts)")
def atr(spark: SparkSession, d: str) -> DataFrame:
    return indicators.atr(adapters.hourly(spark, d), 14).select("instrument", "close_ts", _r("atr").alias("atr"))


@query(
    f"""WITH RECURSIVE {BARS}, {_smooth('f', 'bars', 'close', 12, '2.0::DOUBLE / 13')}, {_smooth('s', 'bars', 'close', 26, '2.0::DOUBLE / 27')}, ln AS (SELECT s.instrument, s.close_ts, f.v - s.v AS x FROM f JOIN s USING (instrument, close_ts)),
    {_smooth('g', 'ln', 'x', 9, '2.0::DOUBLE / 10')} SELECT b.instrument, b.close_ts, round(CASE WHEN g.v IS NOT NULL THEN ln.x END, 4) AS macd, round(g.v, 4) AS signal, round(ln.x - g.v, 4) AS histogram FROM bars b LEFT JOIN ln USING (instrument, close_ts) LEFT JOIN g USING (instrument, close_ts)"""
)
def macd(spark: SparkSession, d: str) -> DataFrame:
    return indicators.macd(adapters.hourly(spark, d)).select("instrument", "close_ts", *(_r(c).alias(c) for c in ("macd", "signal", "histogram")))


@query(f"WITH {BARS}, q AS (SELECT o_orderkey AS k, 'click' AS instrument, {19723 * 24 * H} + (o_orderkey * 7919 * 1000000) % {31 * 24 * H} AS ts FROM orders) SELECT q.k, q.ts, b.close_ts AS bar_ts, b.close FROM q ASOF LEFT JOIN bars b ON q.instrument = b.instrument AND q.ts >= b.close_ts")
def asof_last_bar(spark: SparkSession, d: str) -> DataFrame:
    q = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("click").alias("instrument"), (F.lit(19723 * 24 * H) + (F.col("o_orderkey") * 7919 * 1_000_000) % F.lit(31 * 24 * H)).alias("ts"))
    b = adapters.hourly(spark, d).select("instrument", "close_ts", F.col("close_ts").alias("bar_ts"), "close")
    return lookups.as_of(q, b, "instrument", "ts", "close_ts", ["bar_ts", "close"]).select("k", "ts", "bar_ts", "close")


@query(f"WITH {BARS} SELECT a.close_ts, a.close AS click, b.close AS view FROM bars a LEFT JOIN bars b ON a.close_ts = b.close_ts AND b.instrument = 'view' WHERE a.instrument = 'click'")
def exact_bar(spark: SparkSession, d: str) -> DataFrame:
    b = adapters.hourly(spark, d)
    return lookups.exact(b.where("instrument = 'click'").select("close_ts", F.col("close").alias("click")), b.where("instrument = 'view'").select("close_ts", F.col("close").alias("view")), ["close_ts"], ["view"])


@query(f"WITH {BARS} SELECT a.instrument AS one, b.instrument AS two, min(a.close_ts) AS ts FROM bars a JOIN bars b ON a.close_ts = b.close_ts AND a.instrument < b.instrument WHERE b.volume > a.volume GROUP BY 1, 2")
def volume_crossover(spark: SparkSession, d: str) -> DataFrame:
    b = adapters.hourly(spark, d)
    names = b.select("instrument").distinct()
    pairs = names.alias("x").join(names.alias("y"), F.col("x.instrument") < F.col("y.instrument")).select(F.col("x.instrument").alias("one"), F.col("y.instrument").alias("two"))
    one = b.join(pairs, b["instrument"] == pairs["one"]).select("one", "two", "close_ts", "volume")
    two = b.join(pairs, b["instrument"] == pairs["two"]).select("one", "two", "close_ts", "volume")
    return lookups.first_crossing(one, two, ["one", "two"])


@query(
    f"""WITH {BARS}, i AS (SELECT c_mktsegment AS segment, n_name AS nation, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
    m AS (SELECT DISTINCT instrument, dense_rank() OVER (ORDER BY instrument) - 1 AS k FROM bars) SELECT b.instrument, close_ts, volume, segment, nation FROM bars b JOIN m USING (instrument) JOIN i ON i.k = m.k"""
)
def instrument_dim(spark: SparkSession, d: str) -> DataFrame:
    """Bars with reference data: instruments and customers are numbered, and equal numbers belong together. Only the distinct instruments and as many customers are put in
    order; the side is broadcast if it is counted to be small."""
    b = adapters.hourly(spark, d)
    names = b.select("instrument").distinct().withColumn("k", F.row_number().over(Window.orderBy("instrument")) - 1)
    reference = adapters.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment")).orderBy("c_custkey").limit(names.count())
    numbered = reference.withColumn("k", F.row_number().over(Window.orderBy("c_custkey")) - 1)
    nations = adapters.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    ids = names.join(numbered, "k").join(nations, "c_nationkey").select("instrument", "segment", "nation")
    return b.join(lookups.small(ids), "instrument").select("instrument", "close_ts", "volume", "segment", "nation")
