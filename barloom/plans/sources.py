"""Queries that write and read back through sources, sinks and the store; venues answer without a network."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import fixed, times
from barloom.operators import futures, instruments, orders, report, runs, strategies
from barloom.operators.instruments import Costs
from barloom.plans.market import BARS, TICKS
from barloom.plans.registry import query
from barloom.plans.simulation import SPOT
from barloom.plans.trading import FILLS, _cross
from barloom.session import shared_folder
from barloom.sources import adapters, files, venues
from barloom.streaming import feed, session

H = times.HOUR


@query(f"WITH {BARS} SELECT instrument, {H} AS timeframe, open_ts, close_ts, open, high, low, close, volume FROM bars")
def tape_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as tapes and read back."""
    at = shared_folder(spark, "tapes")
    files.write_tapes(adapters.hourly(spark, d), at, H, 2, 0)
    return files.read_tape(spark, at)


@query(f"WITH {TICKS} SELECT instrument, ts_us AS ts, price, size, aggressor FROM ticks")
def tick_tape_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "tick-tapes")
    files.write_tapes(adapters.ticks(spark, d).withColumnRenamed("ts_us", "ts"), at, 0, 2, 0, kind="ticks")
    return files.read_tape(spark, at, "ticks")


@query(f"WITH {BARS} SELECT instrument, {H} AS timeframe, open_ts, close_ts, open, high, low, close, volume * 1000 AS volume FROM bars WHERE instrument = 'click' AND open_ts >= {19730 * 24 * H} AND close_ts <= {19740 * 24 * H}")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bars of an instrument as delimited text with decimal prices and ISO times, and a range of them read back at other scales."""
    at = shared_folder(spark, "csv")
    b = adapters.hourly(spark, d).where("instrument = 'click'")
    text = b.select(times.to_iso(F.col("open_ts")).alias("Time"), *(fixed.format_fixed(F.col(c), 2).alias(c.title()) for c in ("open", "high", "low", "close")), F.col("volume").cast("string").alias("Vol"))
    text.write.option("header", True).option("sep", ";").csv(at)
    return files.read_csv(spark, at, "click", H, 2, 3, {"timestamp": "time", "volume": "vol"}, sep=";", since=19730 * 24 * H, until=19740 * 24 * H)


def _stored(spark: SparkSession, d: str) -> files.Store:
    store = files.Store(spark, shared_folder(spark, "store"))
    b = adapters.hourly(spark, d)
    store.put_bars(b.where("instrument <> 'view'").withColumn("timeframe", F.lit(H)))
    # A second write replaces what it has, and leaves the others.
    store.put_bars(b.where("instrument = 'click'").withColumn("volume", F.col("volume") + 1).withColumn("timeframe", F.lit(H)))
    store.put_bars(b.where("instrument = 'view'").withColumn("timeframe", F.lit(H)))
    return store


@query(f"WITH {BARS} SELECT instrument, {H} AS timeframe, min(open_ts) AS from_ts, max(close_ts) AS to_ts, count(*) AS bar_count FROM bars GROUP BY 1")
def store_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).coverage().withColumn("timeframe", F.col("timeframe").cast("long"))


@query(f"WITH {BARS} SELECT open_ts, close_ts, open, high, low, close, volume + 1 AS volume FROM bars WHERE instrument = 'click' AND open_ts >= {19725 * 24 * H} AND close_ts <= {19735 * 24 * H}")
def store_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of stored bars, of which the last write counts."""
    return _stored(spark, d).bars("click", H, 19725 * 24 * H, 19735 * 24 * H).drop("instrument", "timeframe")


def _runs(spark: SparkSession, d: str) -> files.Store:
    store = files.Store(spark, shared_folder(spark, "runs"))
    b = adapters.hourly(spark, d)
    for at, fast in ((10, 4), (20, 8), (30, 8)):
        name = F.concat(F.lit(f"{fast}/"), "instrument")
        store.save_run(runs.run(b.where("instrument <> 'view'" if at == 30 else "true"), "sma-crossover", SPOT, Costs(("bps", 15), ("bps", 10, 10, 0)), name, fast=fast, slow=24, qty=10), at)
    return store


@query(f"WITH {BARS}, n AS (SELECT DISTINCT instrument FROM bars) SELECT '4/' || instrument AS run_id, 10 AS created_at FROM n UNION ALL SELECT '8/' || instrument, CASE WHEN instrument = 'view' THEN 20 ELSE 30 END FROM n")
def store_runs(spark: SparkSession, d: str) -> DataFrame:
    """Saved runs by their last write."""
    return _runs(spark, d).runs(1000)


@query(f"WITH {_cross(8, 24, 10, 10, 15)} SELECT close_ts AS ts, CAST(equity + 900000000000000 AS BIGINT) AS equity FROM run WHERE instrument = 'click'")
def store_run_equity(spark: SparkSession, d: str) -> DataFrame:
    """The equity curve of a stored run."""
    return runs.equity(_runs(spark, d).run("8/click")).select("ts", "equity")


@query(
    f"""WITH {_cross(8, 24, 10, 10, 15)}, c AS (SELECT *, lag(position, 1, 0) OVER (PARTITION BY instrument ORDER BY close_ts) AS was FROM run WHERE instrument = 'click')
    SELECT count(*) AS bars, count(*) FILTER (was <> 0 AND delta <> 0) AS trades, round(CAST(sum(commission) AS DOUBLE) / 1e8, 4) AS commission, round((arg_max(equity, close_ts) - 100000000000000)::DOUBLE / 1e8, 4) AS net_profit, count(*) FILTER (delta <> 0) AS fills FROM c"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Some of a report's figures, as its JSON has them."""
    events = runs.run(adapters.hourly(spark, d).where("instrument = 'click'"), "sma-crossover", SPOT, Costs(("bps", 15), ("bps", 10, 10, 0)), F.lit("r"), fast=8, slow=24, qty=10)
    s = json.loads(report.to_json(report.summary(events, "r")))
    row = (s["period"]["bars"], s["trades"]["count"], round(float(s["costs"]["commissionPaid"]), 4), round(float(s["equity"]["netProfit"]), 4), runs.fills(events).count())
    return spark.createDataFrame([row], "bars long, trades long, commission double, net_profit double, fills long")


@query(f"WITH {_cross(8, 24, 10, 10, 15)} SELECT instrument, count(*) FILTER (delta <> 0) AS fills, count(*) AS points FROM run GROUP BY 1")
def run_json(spark: SparkSession, d: str) -> DataFrame:
    """A run as canonical JSON lines, read back and counted."""
    at = shared_folder(spark, "json")
    events = runs.run(adapters.hourly(spark, d), "sma-crossover", SPOT, Costs(("bps", 15), ("bps", 10, 10, 0)), F.col("instrument"), fast=8, slow=24, qty=10)
    runs.canonical(events).select("json").write.text(at)
    rows = spark.read.schema("kind string, instrument string, amount long").json(at)
    return rows.groupBy("instrument").agg(F.count_if(F.col("kind") == "fill").alias("fills"), F.count_if(F.col("kind") == "equity").alias("points"))


def offline(url: str) -> tuple[int, dict, bytes]:
    """Answers as venues give them, made up from the URL: candles of every hour with prices that follow the time, and bulletins."""
    parts = urlsplit(url)
    q = {k: v[0] for k, v in parse_qs(parts.query).items()}
    if "interval" in q:
        a, z = int(q["startTime"]), int(q["endTime"])
        hours = range(-(-a // 3_600_000), z // 3_600_000 + 1)
        return 200, {}, json.dumps([[h * 3_600_000, f"{h % 89}.10", f"{h % 89 + 2}.00", f"{h % 89}.00", f"{h % 89}.50", "3.25", (h + 1) * 3_600_000 - 1] for h in hours]).encode()
    if "granularity" in q:
        rows = [[h * 3600, h % 89, h % 89 + 2, h % 89 + 0.1, h % 89 + 0.5, 3.25] for h in range(-(-int(q["start"]) // 3600), int(q["end"]) // 3600 + 1)]
        return 200, {}, json.dumps((rows + rows[:1])[::-1]).encode()
    day = dt.datetime.strptime(parts.path[-10:-4], "%y%m%d").date()
    if day.day % 7 == 0:
        return 404, {}, b""
    record = f"<PricRpt><TradDt><Dt>{day}</Dt></TradDt><SctyId><TckrSymb>WINM25</TckrSymb></SctyId><FrstPric>{day.day}</FrstPric><MaxPric>{day.day + 2}</MaxPric><MinPric>1</MinPric><LastPric>{day.day + 1}</LastPric><FinInstrmQty>9</FinInstrmQty></PricRpt>"
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("p.xml", f"<D xmlns='urn:x'>{record}</D>")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("p.zip", inner.getvalue())
    return 200, {}, outer.getvalue()


_CANDLES = f"SELECT 'S' AS instrument, h * {H} AS open_ts, (h + 1) * {H} AS close_ts, h % 89 * 100 + 10 AS open, (h % 89 + 2) * 100 AS high, h % 89 * 100 AS low, h % 89 * 100 + 50 AS close, 325 AS volume FROM (SELECT unnest(generate_series(480001, 482499)) AS h)"


def _venue(spark: SparkSession, venue: str) -> DataFrame:
    spark.dataSource.register(venues.VenueSource)
    options = {"venue": venue, "base": "https://venue.invalid", "symbol": "S", "timeframe": "1h", "since": 480_001 * H, "until": 482_500 * H, "fetch": "barloom.plans.sources:offline"}
    return venues.scaled(spark.read.format("venue").options(**options).load(), 2, 2)


@query(_CANDLES)
def venue_klines(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one venue's candles, a partition each."""
    return _venue(spark, "klines")


@query(_CANDLES)
def venue_candles(spark: SparkSession, d: str) -> DataFrame:
    """The same from another venue, whose pages repeat rows and come newest first."""
    return _venue(spark, "candles")


@query(
    "SELECT 'WINM25' AS instrument, epoch_us(x::TIMESTAMP) + 43200000000 AS open_ts, epoch_us(x::TIMESTAMP) + 75600000000 AS close_ts, day(x) AS open, day(x) + 2 AS high, 1::BIGINT AS low, day(x) + 1 AS close, 9::BIGINT AS volume FROM (SELECT CAST(unnest(generate_series(DATE '2025-05-05', DATE '2025-05-30', INTERVAL 1 DAY)) AS DATE) AS x) WHERE dayofweek(x) NOT IN (0, 6) AND day(x) % 7 <> 0"
)
def bulletin_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Daily bulletins of a month's sessions; days without one have no bars."""
    spark.dataSource.register(venues.BulletinSource)
    s = futures.sessions(spark, futures.B3, "2025-05-05", "2025-05-30").orderBy("date").collect()
    options = {"base": "https://venue.invalid", "sessions": json.dumps([[str(r.date), r.open_ts, r.close_ts] for r in s]), "tickers": "WINM25,WINQ25", "fetch": "barloom.plans.sources:offline"}
    return venues.scaled(spark.read.format("bulletin").options(**options).load(), 0, 0)


_FEED = f"""{TICKS}, fr AS (SELECT seq, ts_us, price, size, aggressor, seq % 7 AS k FROM ticks), kd AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'tick' WHEN k = 2 THEN 'bar' WHEN k IN (3, 4) THEN 'ignored' ELSE 'malformed' END AS kind FROM fr)"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as a feed's frames: trades, closed candles, open candles, foreign symbols and broken text."""
    t = adapters.ticks(spark, d)
    ms, price = F.floor(F.col("ts_us") / 1000).cast("string"), F.col("price").cast("string")
    trade = F.concat(F.lit('{"e":"aggTrade","s":"S","p":"'), price, F.lit('","q":"'), F.col("size").cast("string"), F.lit('","T":'), ms, F.lit(',"m":'), F.when(F.col("aggressor") == -1, "true").otherwise("false"), F.lit("}"))
    candle = lambda closed: F.concat(F.lit('{"stream":"x","data":{"e":"kline","s":"S","k":{"t":'), ms, F.lit(',"T":'), ms, F.lit(',"o":"1","h":"2","l":"1","c":"'), price, F.lit(f'","v":"3","x":{closed}}}}}}}'))
    k = F.col("seq") % 7
    text = F.when(k <= 1, trade).when(k == 2, candle("true")).when(k == 3, candle("false")).when(k == 4, F.regexp_replace(trade, '"s":"S"', '"s":"OTHER"')).when(k == 5, F.lit("not json")).otherwise(F.lit('{"e":"kline","s":"S"}'))
    return t.select("seq", text.alias("value"))


@query(f"WITH {_FEED} SELECT kind, count(*) AS n FROM kd GROUP BY 1")
def feed_counters(spark: SparkSession, d: str) -> DataFrame:
    return venues.frames(_frames(spark, d), "S").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_FEED} SELECT seq, CASE WHEN kind = 'tick' THEN ts_us // 1000 * 1000 END AS ts, CASE WHEN kind = 'bar' THEN (ts_us // 1000 + 1) * 1000 END AS close_ts, CAST(price AS VARCHAR) AS price, CASE WHEN kind = 'tick' THEN CASE WHEN aggressor = -1 THEN -1 ELSE 1 END END AS aggressor FROM kd WHERE kind IN ('tick', 'bar')")
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is in a feed's frames."""
    f = venues.frames(_frames(spark, d), "S").where("kind in ('tick', 'bar')")
    return f.select("seq", "ts", "close_ts", F.coalesce("price", "close").alias("price"), "aggressor")


_SPECS = """sp AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE 'P' || p_partkey END AS symbol, 'V' AS venue, CAST(p_partkey % 17 AS INTEGER) - 1 AS pe, CAST(p_partkey % 5 AS INTEGER) AS qe,
  CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN 'x' WHEN 2 THEN '5' ELSE '0.0100' END AS ts, CASE p_partkey % 4 WHEN 0 THEN '-1' ELSE '1.000' END AS ls, CASE p_partkey % 9 WHEN 0 THEN NULL ELSE '0.20' END AS pv FROM part),
  nu AS (SELECT *, CASE WHEN regexp_full_match(ts, '[+-]?[0-9]+([.][0-9]+)?') AND pe >= 0 THEN CAST(round(ts::DECIMAL(18, 4)::DOUBLE * pow(10, pe)) AS BIGINT) END AS tick, CASE WHEN qe >= 0 THEN CAST(round(ls::DOUBLE * pow(10, qe)) AS BIGINT) END AS lot FROM sp)"""


@query(
    f"""WITH {_SPECS.replace('regexp_full_match(ts', 'ts <> ' + chr(39) + 'x' + chr(39) + ' AND regexp_full_match(ts')} SELECT k, venue || ':' || trim(symbol) AS key, CASE WHEN trim(symbol) = '' THEN 'symbol' WHEN NOT pe BETWEEN 0 AND 15 THEN 'price_exp' WHEN pe + qe > 15 THEN 'scale' WHEN coalesce(tick, 0) <= 0 THEN 'tick_size'
    WHEN coalesce(lot, 0) <= 0 THEN 'lot_size' WHEN pv IS NULL THEN 'point_value' END AS error FROM nu"""
)
def instrument_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Specifications of all parts as instruments, sound and unsound ones, with the first thing that cannot be right."""
    k = F.col("p_partkey")
    specs = adapters.table(spark, d, "part").select(
        k.alias("k"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("symbol"), F.lit("V").alias("venue"), F.lit("spot").alias("kind"), (k % 17 - 1).cast("int").alias("price_exp"), (k % 5).cast("int").alias("qty_exp"),
        F.when(k % 6 == 0, "0").when(k % 6 == 1, "x").when(k % 6 == 2, "5").otherwise("0.0100").alias("tick_size"), F.when(k % 4 == 0, "-1").otherwise("1.000").alias("lot_size"), F.when(k % 9 != 0, "0.20").alias("point_value"),
    )
    return instruments.resolved(specs).select("k", "key", "error")


@query(
    "WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_custkey || '.50000' WHEN 2 THEN o_custkey || '.000' ELSE '0.0' || o_custkey || '0' END AS t FROM orders) SELECT k, len(rtrim(CASE WHEN contains(t, '.') THEN split_part(t, '.', 2) ELSE '' END, '0')) AS decimals, CASE WHEN contains(t, '.') THEN rtrim(rtrim(t, '0'), '.') ELSE t END AS trimmed FROM x"
)
def scale_from_decimals(spark: SparkSession, d: str) -> DataFrame:
    """An increment's decimals, and its text without zeros at the end."""
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    t = F.when(k == 0, c).when(k == 1, F.concat(c, F.lit(".50000"))).when(k == 2, F.concat(c, F.lit(".000"))).otherwise(F.concat(F.lit("0.0"), c, F.lit("0")))
    o = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), t.alias("t"))
    return o.select("k", instruments.decimals_of(F.col("t")).cast("long").alias("decimals"), instruments.trim_zeros(F.col("t")).alias("trimmed"))


@query("SELECT o_orderkey AS k, CAST(printf('%.11e', o_totalprice / (o_custkey % 97 + 3)) AS DOUBLE) AS figure FROM orders")
def significant_digits(spark: SparkSession, d: str) -> DataFrame:
    o = adapters.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), fixed.significant(F.col("o_totalprice") / (F.col("o_custkey") % 97 + 3)).alias("figure"))


def _made(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = adapters.hourly(spark, d)
    return b, strategies.crossover(b, SPOT, Costs(("bps", 15), ("bps", 10, 10, 0)), fast=8, slow=24, qty=10)


@query(f"WITH {BARS} SELECT DISTINCT instrument, 0::BIGINT AS gap FROM bars")
def ledger_identity(spark: SparkSession, d: str) -> DataFrame:
    """Equity is cash plus realised and unrealised results less commission, for every run."""
    return runs.identity(*_made(spark, d), SPOT)


@query(
    f"""WITH {_cross(8, 24, 10, 10, 15)}, t AS (SELECT *, CAST(sum(CASE WHEN delta <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY close_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trade FROM run),
    h AS (SELECT instrument, trade, count(*) AS n, trade < max(max(trade)) OVER (PARTITION BY instrument) AS closed FROM t GROUP BY 1, 2) SELECT instrument, count(*) FILTER (trade > 0 AND closed) AS trades, round(coalesce(avg(n) FILTER (trade > 0 AND closed), 0), 6) AS avg_bars,
    round(coalesce(sum(n) FILTER (trade > 0 AND closed), 0) / sum(n), 6) AS exposure FROM h GROUP BY 1"""
)
def exposure(spark: SparkSession, d: str) -> DataFrame:
    """Bars held by closed trades, on average and of all bars."""
    events = runs.run(adapters.hourly(spark, d), "sma-crossover", SPOT, Costs(("bps", 15), ("bps", 10, 10, 0)), F.col("instrument"), fast=8, slow=24, qty=10)
    return runs.exposure(events).select(F.col("run_id").alias("instrument"), "trades", F.round("avg_bars", 6).alias("avg_bars"), F.round("exposure", 6).alias("exposure"))


@query(f"WITH {FILLS} SELECT instrument, count(*) AS n FROM fills WHERE seq >= 1000 GROUP BY 1")
def fills_after_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return runs.fills_after(adapters.fills(spark, d), 1000)


@query(
    f"""WITH RECURSIVE {FILLS}, n AS (SELECT o_custkey AS k, o_orderkey AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_custkey % 20 + o_orderkey % 3 AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    a(k, i, v, w) AS (SELECT DISTINCT k, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM n UNION ALL SELECT n.k, n.i, CASE WHEN a.w + n.w = 0 THEN 0 ELSE CAST(CASE WHEN abs((a.v::HUGEINT * a.w + n.v * n.w) % (a.w + n.w)) * 2 > a.w + n.w OR abs((a.v::HUGEINT * a.w + n.v * n.w) % (a.w + n.w)) * 2 = a.w + n.w AND ((a.v::HUGEINT * a.w + n.v * n.w) // (a.w + n.w)) % 2 <> 0
      THEN (a.v::HUGEINT * a.w + n.v * n.w) // (a.w + n.w) + 1 ELSE (a.v::HUGEINT * a.w + n.v * n.w) // (a.w + n.w) END AS BIGINT) END, a.w + n.w FROM a JOIN n ON n.k = a.k AND n.i = a.i + 1)
    SELECT k, arg_max(v, i) AS average FROM a WHERE i > 0 GROUP BY 1"""
)
def weighted_price(spark: SparkSession, d: str) -> DataFrame:
    """The average price of each customer's orders as it is kept from one to the next, rounded at each step. A group is one customer's orders."""
    o = adapters.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderkey").alias("seq"), adapters.cents("o_totalprice").alias("v"), (F.col("o_custkey") % 20 + F.col("o_orderkey") % 3).alias("w")).alias("x"))
    lists = o.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select("k", fixed.running_average(F.col("xs.v"), F.col("xs.w")).alias("average"))


@query("SELECT o_orderkey AS k, ['pending', 'working', 'partially_filled', 'filled', 'cancelled', 'rejected', 'expired'][o_orderkey % 7 + 1] IN ('pending', 'working', 'partially_filled') AS live FROM orders")
def live_orders(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(x) for x in ("pending", "working", "partially_filled", "filled", "cancelled", "rejected", "expired"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), orders.live(status).alias("live"))


@query("WITH r AS (SELECT 'V' || n_regionkey || ':' || n_name AS key, n_nationkey AS id FROM nation), q AS (SELECT c_custkey AS k, 'V' || (c_custkey % 6) || ':' || n_name AS key FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT q.k, q.key, r.id, r.id IS NOT NULL AS known FROM q LEFT JOIN r USING (key)")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Keys of venue and symbol looked up in a registry; some are not in it."""
    nation = adapters.table(spark, d, "nation")
    registry = nation.select(F.concat(F.lit("V"), F.col("n_regionkey").cast("string"), F.lit(":"), "n_name").alias("key"), F.col("n_nationkey").alias("id"))
    wanted = adapters.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.concat(F.lit("V"), (F.col("c_custkey") % 6).cast("string"), F.lit(":"), "n_name").alias("key"))
    return instruments.found(wanted, registry).select("k", "key", "id", "known")


@query("SELECT m AS market, p AS preset FROM (VALUES ('binance-BTCUSDT', 'binanceSpot'), ('binance-BTCUSDT', 'binanceSpotBnb'), ('binance-BTCUSDT', 'stress'), ('binance-BTCUSDT', 'ideal'), ('coinbase-BTC-USD', 'coinbaseExchange'), ('coinbase-BTC-USD', 'stress'), ('coinbase-BTC-USD', 'ideal'), ('other-X', 'stress'), ('other-X', 'ideal')) t(m, p)")
def market_presets(spark: SparkSession, d: str) -> DataFrame:
    """The costs that markets may be run under."""
    return spark.createDataFrame([(m, p) for m in ("binance-BTCUSDT", "coinbase-BTC-USD", "other-X") for p in instruments.presets_for(m)], "market string, preset string")


def received(url: str, place: int) -> list[str]:
    """A feed of a hundred frames, which is cut now and then (every third time that it is asked)."""
    received.asked = getattr(received, "asked", 0) + 1
    if received.asked % 3 == 2:
        raise ConnectionError(url)
    texts = [f'{{"e":"aggTrade","s":"S","p":"{i}","q":"2","T":{i},"m":{"true" if i % 2 else "false"}}}' if i % 10 else "broken" for i in range(100)]
    return texts[place : place + 40]


@query("SELECT i AS place, CASE WHEN i % 10 = 0 THEN 'malformed' ELSE 'tick' END AS kind, CASE WHEN i % 10 <> 0 THEN i * 1000 END AS ts, CASE WHEN i % 10 <> 0 THEN CASE WHEN i % 2 = 1 THEN -1 ELSE 1 END END AS aggressor FROM (SELECT unnest(generate_series(0, 99)) AS i)")
def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """A feed read as a stream until all its frames have come, over cuts of its connection."""
    spark.dataSource.register(feed.FeedSource)
    at = shared_folder(spark, "feed")
    stream = spark.readStream.format("feed").options(url="wss://venue.invalid/ws", source="barloom.plans.sources:received").load()
    rows = session.run_until(stream, f"{at}/out", f"{at}/state", seconds=120, most_rows=100)
    return venues.frames(rows.where("kind = 'frame'").drop("kind"), "S").select("place", "kind", "ts", "aggressor").distinct()
