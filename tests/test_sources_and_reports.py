from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import report, runs
from barloom.operators.instruments import Costs, Instrument
from barloom.sources import venues


def fake_fetch(url: str):
    """Pages of a venue without a network: a candle each hour, the last one not closed."""
    from urllib.parse import parse_qs, urlsplit

    q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    if "interval" in q:
        a, z = int(q["startTime"]), int(q["endTime"])
        return 200, {}, json.dumps([[t, "1.10", "2", "1", "1.5", "3", t + 3_600_000 - 1] for t in range(a, z + 1, 3_600_000)]).encode()
    a, z = int(q["start"]), int(q["end"])
    rows = [[t, 1, 2, 1.5, 1.25, 7] for t in range(a, z + 1, 3600)]
    return 200, {}, json.dumps((rows + rows[:1])[::-1]).encode()


@pytest.mark.parametrize("venue", ["klines", "candles"])
def test_pages_are_read_once_and_in_full(spark, venue):
    spark.dataSource.register(venues.VenueSource)
    n = 2500
    df = spark.read.format("venue").options(venue=venue, base="https://x", symbol="S", timeframe="1h", since=0, until=n * times.HOUR, fetch="test_sources_and_reports:fake_fetch").load()
    rows = df.collect()
    assert sorted(r["open_ts"] for r in rows) == [i * times.HOUR for i in range(n)] and {r["close_ts"] - r["open_ts"] for r in rows} == {times.HOUR}
    assert df.rdd.getNumPartitions() == (3 if venue == "klines" else 9)


def test_unknown_intervals_and_retries():
    with pytest.raises(ValueError, match="interval"):
        venues.VenueReader({"base": "https://x", "symbol": "S", "timeframe": "7m", "since": "0", "until": "1"}).partitions()
    answers, waits = [(429, {"Retry-After": "2"}, b""), (503, {}, b""), (200, {}, b"ok")], []
    assert venues.with_retries(lambda _: answers.pop(0), "u", sleep=waits.append) == b"ok" and waits == [2.0, 0.5]
    with pytest.raises(RuntimeError, match="404"):
        venues.with_retries(lambda _: (404, {}, b""), "u")


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ('{"e":"kline","s":"S","k":{"t":0,"T":59999,"o":"1","h":"2","l":"1","c":"2","v":"3","x":true}}', "bar"),
        ('{"stream":"a","data":{"e":"aggTrade","s":"S","p":"1","q":"2","T":5,"m":true}}', "tick"),
        ('{"e":"kline","s":"S","k":{"x":false}}', "ignored"), ('{"e":"aggTrade","s":"OTHER"}', "ignored"), ('{"e":"other"}', "ignored"), ("not json", "malformed"), ("[]", "malformed"), ('{"e":"kline","s":"S"}', "malformed"),
    ],
)
def test_frames(text, kind):
    found, row = venues.frame(text, "S")
    assert found == kind and (row is not None) == (kind in ("bar", "tick"))
    if kind == "tick":
        assert row[-1] == -1


def test_bulletins():
    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, c in files.items():
                z.writestr(n, c)
        return out.getvalue()

    record = lambda t, o: f"<PricRpt><TradDt><Dt>2025-06-02</Dt></TradDt><SctyId><TckrSymb>{t}</TckrSymb></SctyId><X>{o}<MaxPric>9</MaxPric><MinPric>1</MinPric><LastPric>5</LastPric><AdjstdQt>6</AdjstdQt></X></PricRpt>"
    last = f"<D xmlns='urn:x'>{record('WINM25', '<FrstPric>4</FrstPric>')}{record('WINQ25', '')}{record('PETR4', '<FrstPric>4</FrstPric>')}</D>"
    data = archive({"a.zip": archive({"1.xml": "<D/>", "2.xml": last})})
    records = venues.bulletin(data, {"WINM25", "WINQ25"})
    assert [r["ticker"] for r in records] == ["WINM25", "WINQ25"]
    assert venues.bulletin_bars(records, 0, 9) == [("WINM25", 0, 9, "4", "9", "1", "5", "0")] and venues.bulletin_bars(records, 0, 9, True)[0][6] == "6"
    assert venues.bulletin(b"", set()) == [] and venues.bulletin_name(dt.date(2025, 6, 2)) == "PR250602.zip"


def test_reports(spark):
    n = 800
    bars = spark.createDataFrame([("X", i * times.HOUR, (i + 1) * times.HOUR, *(p := 100 + (i * 7) % 40,), p + 3, p - 3, p + 1, 50) for i in range(n)], "instrument string, open_ts long, close_ts long, open long, high long, low long, close long, volume long")
    events = runs.run(bars, "sma-crossover", Instrument("X", kind="spot", accounting="cash"), Costs(commission=("bps", 2, 10, 0)), F.lit("r<1>"), 10**12, fast=3, slow=9).persist()
    s = report.summary(events, "r<1>")
    assert s["period"]["bars"] == n and s["trades"]["count"] == s["trades"]["wins"] + s["trades"]["losses"] + events.where("kind='trade' and amount = commission").count()
    total = events.where("kind = 'trade'").agg(F.sum(F.col("amount") - F.col("commission"))).first()[0]
    assert s["equity"]["netProfit"] is not None and total is not None
    assert json.loads(report.to_json(s)) == s and "trades" in report.to_text(s)
    page = report.to_html(events, "r<1>")
    assert "<script" not in page and "r&lt;1&gt;" in page and page.count("<tr>") > 30
    assert report.money(-150000000) == "-1.50000000" and report.figure(float("nan")) is None and report.iso(1500) == "1970-01-01T00:00:00.001Z"
    assert report.path([], 1, 1) == "" and report.path([(0, 5), (1, 5)], 10, 10) == "M0.00,5.00L10.00,5.00"


def test_cost_basis_is_dealt_by_trade(spark):
    import random

    from barloom.operators import ledger

    r = random.Random(12)
    rows = [(k, t, t, r.choice((-1, 1)), r.randrange(1, 6), r.randrange(900, 1100)) for k in ("a", "b") for t in range(400)]
    rows += [("long", t, t, 1, 3, 1000 + t % 7) for t in range(500)] + [("long", 500, 500, -1, 2000, 990)]
    frame = ledger.cost_basis(spark.createDataFrame(rows, "instrument string, ts_us long, seq long, side int, qty long, price long"), 100, 3)
    want = {}
    for k in ("a", "b", "long"):
        p = ledger.Position(100, 3)
        for _, t, _, side, qty, price in (x for x in rows if x[0] == k):
            closed, opened, gained = p.apply(side, qty, price)
            want[k, t] = (side, qty, price, p.qty, p.basis, closed, opened, gained)
    got = {(x["instrument"], x["seq"]): tuple(x)[3:] for x in frame.collect()}
    assert got == want and frame.count() == len(rows)
    assert "FlatMapGroups" not in frame._jdf.queryExecution().toString()
