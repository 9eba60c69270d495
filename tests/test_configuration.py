from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from barloom.errors import ConfigError, DataError, VenueError
from barloom.functions import fixed
from barloom.operators import instruments, orders, report, runs
from barloom.sources import venues
from barloom.streaming import feed


def test_instruments_are_resolved_or_refused():
    win = instruments.load("WIN")
    assert (win.tick, win.lot, win.point_value, win.divisor, win.initial_margin, win.key) == (5, 1, 20_000_000, 1, 1000 * 10**8, "B3:WIN")
    btc = instruments.load("BTCUSDT")
    assert (btc.tick, btc.lot, btc.divisor, btc.accounting) == (1, 1, 10**7, "cash")
    assert instruments.resolve(instruments.stock("PETR4")).kind == "stock"
    sound = instruments.SPECS["WIN"]
    for change in ({"symbol": " "}, {"priceExp": 16}, {"qtyExp": 1.5}, {"priceExp": 9, "qtyExp": 9}, {"tickSize": "0"}, {"tickSize": "x"}, {"lotSize": "0.1"}, {"pointValue": "-1"}, {"kind": "bond"}):
        with pytest.raises(ConfigError):
            instruments.resolve(sound | change)
    assert set(instruments.registry([sound, instruments.SPECS["WDO"]])) == {"B3:WIN", "B3:WDO"}
    with pytest.raises(ConfigError, match="registered"):
        instruments.registry([sound, sound])


def test_tariffs():
    money = lambda text: orders._decimal(text, 8)
    assert orders.tariff_per_contract("WIN") == money("0.30") and orders.tariff_per_contract("WIN", brokerage="0.50") == money("0.80")
    assert orders.tariff_per_contract("WIN", day_trade=True) == money("0.195") and orders.tariff_per_contract("WDO", usd_brl="5.40") == money("0.648")
    for bad in ({"contract": "WDO"}, {"contract": "WIN", "usd_brl": "5"}, {"contract": "WIN", "brokerage": "-1"}):
        with pytest.raises(ConfigError):
            orders.tariff_per_contract(**bad)


def test_presets_price_and_charge(spark):
    own = instruments.load("BTCUSDT")
    row = spark.range(1).select(F.lit(5_000_000).cast("long").alias("p"), F.lit(100_000).cast("long").alias("q"), F.lit(1).alias("s"), F.lit(True).alias("t"))
    for name, (price, fee) in {"ideal": (5_000_000, 0), "binanceSpot": (5_001_000, 50 * 10**8), "binanceSpotBnb": (5_001_000, 3_750_000_000), "coinbaseExchange": (5_001_000, 300 * 10**8)}.items():
        costs = instruments.PRESETS[name]
        got = row.select(costs.price(own, F.col("p"), F.col("s"), F.col("t")).alias("price"), costs.fee(own, fixed.notional(F.col("p"), F.col("q"), own.point_value, own.divisor), F.col("q"), F.col("t")).alias("fee")).first()
        assert tuple(got) == (price, fee), name
    jitter = spark.range(1000).select(orders.jitter(F.lit(100), F.lit(1), F.lit(True), 5, 3, F.col("id")).alias("p"), orders.jitter(F.lit(100), F.lit(1), F.lit(False), 5, 3, F.col("id")).alias("m"))
    assert {r["p"] for r in jitter.collect()} == {100, 105, 110, 115} and {r["m"] for r in jitter.collect()} == {100}


def test_configurations_of_links():
    link = "symbol=BTCUSDT&strategy=mean-reversion&size=1000&costs=binanceSpotBnb&p.rsi=7&p.exit=60.5"
    c = runs.parse_config(link)
    assert c.market == "binance-BTCUSDT" and c.timeframe == "1h" and c.params == {"rsi": 7, "entry": 30.0, "exit": 60.5, "most_bars": 48} and runs.parse_config("?" + c.query()) == c
    assert runs.parse_config("symbol=coinbase-BTC-USD&size=5&costs=coinbaseExchange&tf=4h&p.short=0").params == {"fast": 24, "slow": 72, "short": False}
    for bad in ("", "symbol=other-X&size=1&costs=ideal", "symbol=binance-X&size=1&costs=coinbaseExchange", "symbol=binance-X&size=0&costs=ideal", "symbol=binance-X&size=nan&costs=ideal", "symbol=binance-X&size=1&costs=ideal&tf=2h", "symbol=binance-X&size=1&costs=ideal&strategy=x", "symbol=binance-X&size=1&costs=ideal&p.fast=1.5", "symbol=binance-X&size=1&costs=ideal&p.fast=0", "symbol=binance-X&size=1&costs=ideal&p.short=yes"):
        assert runs.parse_config(bad) is None, bad


def test_venues_describe_their_instruments():
    info = {"symbols": [{"symbol": "BTCUSDT", "quoteAsset": "USDT", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.01000000"}, {"filterType": "LOT_SIZE", "stepSize": "0.00001000"}]}, {"symbol": "X", "quoteAsset": "Y", "filters": []}]}
    assert instruments.resolve(venues.describe_klines(json.dumps(info).encode(), "BTCUSDT")) == instruments.load("BTCUSDT")
    with pytest.raises(VenueError):
        venues.describe_klines(json.dumps(info).encode(), "NONE")
    with pytest.raises(DataError):
        venues.describe_klines(json.dumps(info).encode(), "X")
    found = instruments.resolve(venues.describe_candles(b'{"id": "BTC-USD", "quote_currency": "USD", "quote_increment": "0.01", "base_increment": "0.00000001"}'))
    assert (found.price_exp, found.qty_exp, found.tick, found.lot) == (2, 8, 1, 1)
    with pytest.raises(DataError):
        venues.describe_candles(b"{}")


def test_feeds_ask_again_and_refuse_credentials():
    waits = []
    reader = feed.FeedReader({"url": "wss://x.invalid", "source": "test_configuration:cut"}, waits.append)
    CUTS[:] = [True, True, False]
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == [(0, "gap", None), (0, "gap", None), (0, "frame", "a"), (1, "frame", "b")] and end == {"place": 2} and waits == [0.25, 0.5]
    assert list(reader.readBetweenOffsets({"place": 1}, {"place": 2})) == [(1, "frame", "b")] and feed.backoff(20) == 30.0
    with pytest.raises(ConfigError):
        feed.FeedReader({"url": "wss://user:word@x.invalid", "source": "test_configuration:cut"})
    CUTS[:] = [True] * 9
    with pytest.raises(VenueError):
        reader.read({"place": 0})


def test_feeds_that_are_cut_while_no_frame_comes(spark, tmp_path):
    from barloom.streaming import session

    reader = feed.FeedReader({"url": "wss://x.invalid", "source": "test_configuration:cut"}, lambda _: None)
    for cuts, start, gaps, end in (([True], {"place": 2}, 1, {"place": 2, "cuts": 1}), ([True, True], {"place": 2, "cuts": 1}, 2, {"place": 2, "cuts": 3}), ([], {"place": 2, "cuts": 3}, 0, {"place": 2, "cuts": 3}), ([True], {"place": 1, "cuts": 3}, 1, {"place": 2})):
        CUTS[:] = cuts
        rows, found = reader.read(start)
        rows = list(rows)
        assert [r for r in rows if r[1] == "gap"] == [(start["place"], "gap", None)] * gaps and found == end
        if found["place"] == start["place"]:
            assert list(reader.readBetweenOffsets(start, found)) == rows
    # The whole stream goes on over cuts that no frame follows.
    spark.dataSource.register(feed.FeedSource)
    stream = spark.readStream.format("feed").options(url="wss://venue.invalid/ws", source="barloom.plans.sources:received").load()
    seen = session.run_until(stream, f"{tmp_path}/out", f"{tmp_path}/state", seconds=120, most_rows=103).collect()
    assert sorted(r["place"] for r in seen if r["kind"] == "frame") == list(range(100)) and sum(r["kind"] == "gap" and r["place"] == 100 for r in seen) >= 2


def test_feeds_give_their_frames_again_over_cuts_and_in_parts():
    waits = []
    reader = feed.FeedReader({"url": "wss://x.invalid", "source": "test_configuration:bit", "attempts": "3"}, waits.append)
    CUTS[:] = [True, False, True, True, False]
    assert list(reader.readBetweenOffsets({"place": 0}, {"place": 4, "cuts": 1})) == [*((i, "frame", str(i)) for i in range(4)), (4, "gap", None)] and waits == [0.25, 0.25, 0.5]
    CUTS[:] = [False, True, True, True]
    with pytest.raises(VenueError):
        list(reader.readBetweenOffsets({"place": 0}, {"place": 4}))


def bit(url: str, place: int) -> list[str]:
    """A feed that answers in parts of two frames."""
    cut(url, 0)
    return [str(i) for i in range(place, place + 2)]


CUTS: list[bool] = []


def cut(url: str, place: int) -> list[str]:
    import test_configuration

    if test_configuration.CUTS and test_configuration.CUTS.pop(0):
        raise ConnectionError(url)
    return ["a", "b"][place:]


def test_figures_as_text(spark):
    assert [report.percent(x) for x in (0.1234, None, float("inf"))] == ["12.34%", "n/a", "n/a"]
    assert [report.compact(x) for x in (12.345, -1_234, 5_600_000, None)] == ["12.35", "-1.2k", "5.6M", "n/a"] or report.compact(12.345) == "12.34"
    low, high, ticks = report.axis(0, 100)
    assert (low, high) == (-5, 105) and len(ticks) == 5 and ticks[2] == 50 and report.axis(0, 0)[:2] == (-1, 1) and report.axis(10, 10)[:2] == (9.5, 10.5)
    rows = spark.createDataFrame([("b", "x", 2, 150_000_000, 10**8), ("a", "x", 1, 0, -(10**8))], "venue string, instrument string, fills long, commission long, final_equity long")
    assert [r["venue"] for r in json.loads(report.comparison_json(rows))] == ["a", "b"]
