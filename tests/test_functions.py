from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import fixed, times
from barloom.operators import bars, futures, indicators, metrics
from barloom.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("text", "exp", "value"), [("0.1", 8, 10000000), ("-0.5", 2, -50), ("+7.25", 2, 725), ("1.005", 2, 101), ("-1.005", 2, -101), ("", 2, None), ("abc", 2, None), ("1.2.3", 2, None), ("1e5", 2, None), ("NaN", 2, None), ("--1", 2, None), ("3", 0, 3)])
def test_parse(spark, text, exp, value):
    assert one(spark, fixed.parse_fixed(F.lit(text), exp)) == (value,)


@pytest.mark.parametrize(("a", "d", "mode", "value"), [(5, 2, "trunc", 2), (5, 2, "floor", 2), (5, 2, "ceil", 3), (5, 2, "half-up", 3), (5, 2, "half-even", 2), (7, 2, "half-even", 4), (-5, 2, "trunc", -2), (-5, 2, "floor", -3), (-5, 2, "ceil", -2), (-5, 2, "half-up", -3)])
def test_division(spark, a, d, mode, value):
    assert one(spark, fixed.mul_div(F.lit(a), 1, d, mode)) == (value,)


def test_large_products_and_their_bound(spark):
    assert one(spark, fixed.mul_mul_div(F.lit(7000000), F.lit(10**10), F.lit(10**8), F.lit(10**10))) == (700000000000000,)
    with pytest.raises(Exception, match="beyond 53 bits"):
        one(spark, fixed.mul_div(F.lit(2**53), 2, 1))
    assert one(spark, fixed.weighted_average(F.lit(100), F.lit(1), F.lit(200), F.lit(3)), fixed.weighted_average(F.lit(1), F.lit(0), F.lit(2), F.lit(0))) == (175, 0)


def test_text_of_numbers(spark):
    assert one(spark, *(fixed.format_fixed(F.lit(v), e) for v, e in ((725, 2), (-5, 2), (0, 3), (12, 0)))) == ("7.25", "-0.05", "0.000", "12")
    assert one(spark, fixed.significant(F.lit(1 / 3)), fixed.significant(F.lit(float("nan"))), fixed.js_round(F.lit(-2.5))) == (0.333333333333, None, -2)


def test_times(spark):
    assert times.parse_timeframe("4h") == 4 * times.HOUR and times.format_timeframe(90_000_000) == "90s"
    with pytest.raises(ValueError, match="timeframe"):
        times.parse_timeframe("1w")
    assert one(spark, times.day_index(F.lit(-1)), times.to_millis(F.lit(-1)), times.from_iso(F.lit("2025-08-01T00:00:00.000Z"))) == (-1, -1, 1754006400000000)
    easters = {2021: (4, 4), 2022: (4, 17), 2023: (4, 9), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2027: (3, 28)}
    for year, (m, d) in easters.items():
        assert one(spark, times.easter(F.lit(year))) == (dt.date(year, m, d),)


def _bars(spark, rows, size=times.HOUR):
    return spark.createDataFrame([("X", i * size, (i + 1) * size, *r) for i, r in rows], "instrument string, open_ts long, close_ts long, open long, high long, low long, close long, volume long")


def test_resample(spark):
    rows = [(100, 110, 95, 105, 10), (105, 120, 100, 118, 20), (118, 119, 90, 92, 30), (92, 130, 91, 125, 40)]
    out = bars.resample(_bars(spark, enumerate(rows)), 4 * times.HOUR, times.HOUR).collect()
    assert [tuple(r[c] for c in bars.OHLCV) for r in out] == [(100, 130, 90, 125, 100)] and not out[0]["dropped"]
    part = bars.resample(_bars(spark, enumerate(rows + rows[:2])), 4 * times.HOUR, times.HOUR).orderBy("open_ts").collect()
    assert [(r["n"], r["dropped"]) for r in part] == [(4, False), (2, True)]
    gap = bars.resample(_bars(spark, [(i, rows[0]) for i in (0, 1, 3, 4, 5, 6, 7)]), 4 * times.HOUR, times.HOUR).orderBy("open_ts").collect()
    assert [r["n"] for r in gap] == [3, 4]
    with pytest.raises(ValueError, match="multiple"):
        bars.resample(_bars(spark, enumerate(rows)), times.HOUR // 2, times.HOUR)


def _plain(values, n, alpha):
    """The smoothed series of values by a loop."""
    out, seen, v = [], [], None
    for x in values:
        if x is not None:
            seen.append(x)
            if len(seen) == n:
                v = sum(seen) / n
            elif len(seen) > n:
                v = (1 - alpha) * v + alpha * x
        out.append(v if x is not None else None)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 26])
def test_smoothed_series_over_many_blocks(spark, n):
    x = [None if i % 11 == 5 else float(round(1000 + 300 * np.sin(i / 7) + i % 13)) for i in range(6000)]
    rows = spark.createDataFrame([(name, i, None if v is None else v * scale) for name, scale in (("a", 1), ("b", -3)) for i, v in enumerate(x)], "instrument string, close_ts long, v double")
    made = indicators.ema(indicators.rma(rows, n, F.col("v"), "r"), n, F.col("v"), "e").orderBy("instrument", "close_ts").collect()
    for column, alpha in (("r", 1 / n), ("e", 2 / (n + 1))):
        for name, scale in (("a", 1), ("b", -3)):
            wanted = _plain([None if v is None else v * scale for v in x], n, alpha)
            got = [r[column] for r in made if r["instrument"] == name]
            assert [v is None for v in got] == [v is None for v in wanted]
            assert np.allclose([v for v in got if v is not None], [v for v in wanted if v is not None], rtol=1e-12)


def test_recursive_indicators(spark):
    series = lambda close: spark.createDataFrame([("i", i, c + 2, c - 2, c) for i, c in enumerate(close)], "instrument string, close_ts long, high long, low long, close long")
    of = lambda df, name: [r[name] for r in df.orderBy("close_ts").collect()]
    up = range(1, 40)
    assert of(indicators.rsi(series(up), 14), "rsi")[13:15] == [None, 100]
    assert of(indicators.rsi(series([-x for x in up]), 14), "rsi")[20] == 0 and of(indicators.rsi(series([0] * 39), 14), "rsi")[20] == 50
    lines = indicators.macd(series(up), 3, 6, 3)
    assert [v is None for v in of(lines, "macd")][6:8] == [True, False] and of(lines, "signal")[7] is not None
    assert of(indicators.atr(series([10]), 1), "atr") == [4] and of(indicators.ema(series([1, 2, 3]), 5), "ema") == [None] * 3


def test_drawdowns(spark):
    curve = lambda values: spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, ts long, equity long")
    (e,) = metrics.drawdowns(curve([100, 110, 105, 130])).collect()
    assert (e["depth_money"], e["bars"], e["recovered_ts"]) == (5, 2, 3)
    (e,) = metrics.drawdowns(curve([100, 90])).collect()
    assert (e["depth"], e["recovered_ts"], e["bars"]) == (0.1, None, 1)
    found = metrics.drawdowns(curve([100, 80, 100, 99, 98, 97, 96, 95, 96, 97, 98, 99, 101])).collect()
    assert max(f["depth"] for f in found) == 0.2 and max(f["bars"] for f in found) == 10
    assert metrics.risk(curve([100, 90])).first()["sharpe"] is None


def test_trade_stats(spark):
    rows = spark.createDataFrame([("r", 10, 10, 1), ("r", -4, -4, 1), ("r", 6, 6, 1), ("r", -2, -2, 3)], "run string, net long, gross long, bars long")
    s = metrics.trade_stats(rows).first()
    assert (s["wins"], s["losses"], s["gross_profit"], s["gross_loss"], s["avg_win"], s["avg_loss"], s["avg_bars"]) == (2, 2, 16, 6, 8, 3, 1.5)
    assert metrics.trade_stats(rows.where("net > 0")).first()["profit_factor"] is None


def test_downsample_keeps_ends_of_buckets(spark):
    rows = spark.createDataFrame([("r", i, i) for i in range(52)], "run string, ts long, v long")
    out = metrics.downsample(rows, "v", 23).collect()
    assert len(out) <= 52 and max(r["ts"] for r in out) == 51


def test_calendar_and_contracts(spark):
    s = futures.sessions(spark, futures.B3, "2020-01-01", "2027-12-31")
    open_days = {str(r[0]) for r in s.where(F.year("date") == 2025).select("date").collect()}
    for day in ("01-01", "03-03", "03-04", "04-18", "04-21", "05-01", "06-19", "11-20", "12-24", "12-25", "12-31"):
        assert f"2025-{day}" not in open_days
    assert sum(d.startswith("2025-06") for d in open_days) == 20
    day = lambda us: str(dt.datetime.fromtimestamp(us / 1e6, dt.UTC).date())
    win = futures.contracts(s, futures.SERIES["WIN"], 2025, 2026)
    got = {r["symbol"]: r for r in win.collect()}
    assert [day(got[f"WIN{c}25"]["expiry"]) for c in "GJMQVZ"] == ["2025-02-12", "2025-04-16", "2025-06-18", "2025-08-13", "2025-10-15", "2025-12-17"]
    assert day(got["WINJ25"]["rolls_at"]) == "2025-04-09"
    wdo = {r["symbol"]: day(r["expiry"]) for r in futures.contracts(s, futures.SERIES["WDO"], 2025, 2025).collect()}
    assert [wdo[f"WDO{c}25"] for c in "FHKMU"] == ["2025-01-02", "2025-03-05", "2025-05-02", "2025-06-02", "2025-09-01"]
    at = spark.createDataFrame([(int(dt.datetime(2025, *d, 12, tzinfo=dt.UTC).timestamp() * 1e6),) for d in ((3, 10), (4, 10), (12, 29))], "ts long")
    assert [r["front"] for r in futures.front(at, win, "ts").orderBy("ts").collect()] == ["WINJ25", "WINM25", "WING26"]
    friday = spark.createDataFrame([(int(dt.datetime(2025, 6, 13, 22, tzinfo=dt.UTC).timestamp() * 1e6),)], "ts long")
    assert futures.next_close(friday, s, "ts").first()["next_close"] == int(dt.datetime(2025, 6, 16, 21, tzinfo=dt.UTC).timestamp() * 1e6)


@pytest.mark.parametrize(("method", "closes"), [("difference", [110, 111, 112, 113, 114]), ("none", [100, 101, 112, 113, 114])])
def test_stitching(spark, method, closes):
    row = lambda n, i, p: (n, i, i + 1, p, p, p, p, 1)
    b = spark.createDataFrame([row("F", i, 100 + i) for i in range(4)] + [row("B", i, 110 + i) for i in range(5)], "instrument string, open_ts long, close_ts long, open long, high long, low long, close long, volume long")
    c = spark.createDataFrame([("F", 2, 10), ("B", 90, 100)], "symbol string, rolls_at long, expiry long")
    points = futures.roll_points(b, c)
    assert [(p["symbol"], p["until"], p["gap"]) for p in points.orderBy("expiry").collect()] == [("F", 2, 10), ("B", None, None)]
    assert [r["close"] for r in futures.continuous(b, points, method).orderBy("close_ts").collect()] == closes


def test_tape_round_trip(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame([(0, 60, 1, 3, 1, 2, 5), (60, 120, 2, 4, 2, 3, 6)], columns=["open_ts", "close_ts", "open", "high", "low", "close", "volume"])
    data = files.bars_to_tape(frame, {"symbol": "X"}, 60)
    (tmp_path / "x.tape").write_bytes(data)
    out = files.read_tape(spark, str(tmp_path)).orderBy("open_ts").toPandas()
    assert out[list(frame.columns)].values.tolist() == frame.values.tolist() and set(out["instrument"]) == {"X"}
    ticks = pd.DataFrame({"ts": [1, 2], "price": [5, 6], "size": [7, 8], "aggressor": [1, -1]})
    head, columns = files.decode_tape(files.ticks_to_tape(ticks, {"symbol": "X"}))
    assert head["count"] == 2 and columns["aggressor"].tolist() == [1, -1]
    for bad in (b"", b"NOTATAPE" + data[8:], data[:-20]):
        with pytest.raises(ValueError, match="tape"):
            files.decode_tape(bad)


def test_csv_and_store(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Timestamp,Open,High,Low,Close,Volume\n2025-08-01T00:00:00.000Z,"1.10",2.5,1,2,0.00001\n2025-08-01T01:00:00.000Z,2,2,2,2,1\n')
    out = files.read_csv(spark, str(tmp_path / "b.csv"), "X", times.HOUR, 2, 5).orderBy("open_ts")
    first = out.first()
    assert (first["open"], first["high"], first["volume"], first["close_ts"] - first["open_ts"]) == (110, 250, 1, times.HOUR)
    store = files.Store(spark, str(tmp_path / "store"))
    store.put_bars(out)
    assert store.bars("X", times.HOUR, first["open_ts"], first["close_ts"]).count() == 1
    assert store.covering("X", times.HOUR, first["open_ts"], first["close_ts"]).first()["bar_count"] == 2
    with pytest.raises(ValueError, match="no such columns"):
        files.read_csv(spark, str(tmp_path / "b.csv"), "X", times.HOUR, 2, 5, {"close": "last"})


def test_violations_stop_a_checked_query(spark):
    good = _bars(spark, [(0, (1, 2, 1, 2, 1))])
    assert bars.checked(good).count() == 1
    with pytest.raises(Exception, match="breaks rule: range"):
        bars.checked(_bars(spark, [(0, (1, 1, 2, 1, 1))])).collect()
