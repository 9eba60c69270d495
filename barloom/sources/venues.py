"""Bars and trades from venues: REST pages as a Python data source, stream frames, and zipped daily bulletins.

A request's pages are known beforehand (each covers a window of time), so each is a partition of its own and is fetched by an executor. What fetches is
named by the option ``fetch`` (``module:function``, given a URL, returning status, headers and body), which tests point to files.
"""

from __future__ import annotations

import datetime as dt
import importlib
import io
import json
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.errors import ConfigError, DataError, VenueError
from barloom.functions import fixed, times

#: Intervals that the venues publish, in microseconds (fixed values).
KLINE_INTERVALS = {60_000_000 * m: n for m, n in ((1, "1m"), (3, "3m"), (5, "5m"), (15, "15m"), (30, "30m"), (60, "1h"), (120, "2h"), (240, "4h"), (360, "6h"), (480, "8h"), (720, "12h"), (1440, "1d"), (4320, "3d"), (10080, "1w"))}
CANDLE_SECONDS = (60, 300, 900, 3_600, 21_600, 86_400)
KLINE_PAGE, CANDLE_PAGE = 1_000, 300
RETRY = frozenset((408, 418, 425, 429, 500, 502, 503, 504))
SCHEMA = "instrument string, open_ts long, close_ts long, open string, high string, low string, close string, volume string"

Fetch = Callable[[str], tuple[int, dict, bytes]]


def fetch_url(url: str) -> tuple[int, dict, bytes]:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    if not url.startswith("https://"):
        raise ValueError("only https is fetched")
    try:
        with urlopen(url, timeout=30) as r:
            return r.status, dict(r.headers), r.read()
    except HTTPError as e:
        return e.code, dict(e.headers), b""


def with_retries(fetch: Fetch, url: str, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body, asking again after what the server says or 250 ms doubled each time."""
    for i in range(attempts):
        status, headers, body = fetch(url)
        if status == 200:
            return body
        if status not in RETRY or i == attempts - 1:
            raise VenueError(f"{url} answered {status}")
        wait = str({k.lower(): v for k, v in headers.items()}.get("retry-after", ""))
        sleep(float(wait) if wait.replace(".", "", 1).isdigit() else 0.25 * 2**i)
    raise AssertionError


def klines(body: bytes, symbol: str, until_ms: int) -> Iterator[tuple]:
    """Rows of a page of klines; a candle that has not closed by ``until_ms`` is left out."""
    for row in json.loads(body):
        opened, o, h, low, c, v, closed = row[:7]
        if closed <= until_ms:
            yield symbol, opened * 1_000, (closed + 1) * 1_000, o, h, low, c, v


def candles(body: bytes, symbol: str, timeframe: int, until: int) -> list[tuple]:
    """Rows of a page of candles, oldest first, each time once; gaps stay gaps."""
    rows = {r[0]: r for r in json.loads(body, parse_float=str, parse_int=str)}
    out = []
    for at in sorted(rows, key=int):
        t, low, high, o, c, v = rows[at]
        opened = int(t) * 1_000_000
        if opened + timeframe <= until:
            out.append((symbol, opened, opened + timeframe, o, high, low, c, v))
    return out


class Page(InputPartition):
    def __init__(self, url: str, since: int, until: int):
        super().__init__(url)
        self.url, self.since, self.until = url, since, until


class VenueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        self.symbol, self.timeframe = options["symbol"], times.parse_timeframe(options["timeframe"])
        self.since, self.until = int(options["since"]), int(options["until"])
        self.venue, self.base = options.get("venue", "klines"), options["base"].rstrip("/")

    def partitions(self) -> list[Page]:
        if self.venue == "klines":
            if self.timeframe not in KLINE_INTERVALS:
                raise ConfigError("the venue publishes no such interval")
            size, name = KLINE_PAGE * self.timeframe, KLINE_INTERVALS[self.timeframe]
            url = lambda a, z: f"{self.base}/api/v3/klines?symbol={self.symbol}&interval={name}&startTime={a // 1_000}&endTime={z // 1_000}&limit={KLINE_PAGE}"
        else:
            seconds = self.timeframe // 1_000_000
            if seconds not in CANDLE_SECONDS:
                raise ConfigError("the venue publishes no such granularity")
            size = CANDLE_PAGE * self.timeframe
            url = lambda a, z: f"{self.base}/products/{self.symbol}/candles?granularity={seconds}&start={a // 1_000_000}&end={(z - self.timeframe) // 1_000_000}"
        return [Page(url(a, min(a + size, self.until)), a, min(a + size, self.until)) for a in range(self.since, self.until, size)]

    def read(self, page: Page) -> Iterator[tuple]:
        fetch = fetch_url
        if named := self.o.get("fetch"):
            module, _, name = named.partition(":")
            fetch = getattr(importlib.import_module(module), name)
        body = with_retries(fetch, page.url)
        rows = klines(body, self.symbol, self.until // 1_000) if self.venue == "klines" else candles(body, self.symbol, self.timeframe, self.until)
        # Both ends of a window may belong to two pages; a row belongs to the page that it opens in.
        yield from (r for r in rows if page.since <= r[1] < page.until)


class VenueSource(DataSource):
    """``spark.read.format("venue")`` with options venue (klines or candles), base, symbol, timeframe, since, until; prices stay text."""

    @classmethod
    def name(cls) -> str:
        return "venue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VenueReader:
        return VenueReader(self.options)


def scaled(rows: DataFrame, price_exp: int, qty_exp: int) -> DataFrame:
    """Bars of SCHEMA with prices and volume at the instrument's scales."""
    return rows.select("instrument", "open_ts", "close_ts", *(fixed.parse_fixed(F.col(c), price_exp).alias(c) for c in ("open", "high", "low", "close")), fixed.parse_fixed(F.col("volume"), qty_exp).alias("volume"))


def _decimals(text: str) -> int:
    return len(text.partition(".")[2].rstrip("0"))


def describe_klines(body: bytes, symbol: str) -> dict:
    """The specification of an instrument from the venue's exchange information: scales are the decimals of its increments."""
    found = next((x for x in json.loads(body).get("symbols", []) if x.get("symbol") == symbol), None)
    if found is None:
        raise VenueError(f"the venue does not list {symbol}")
    filters = {f["filterType"]: f for f in found.get("filters", [])}
    try:
        tick, lot = filters["PRICE_FILTER"]["tickSize"], filters["LOT_SIZE"]["stepSize"]
    except KeyError as e:
        raise DataError(f"{symbol}: no {e.args[0]} in the exchange information") from None
    return {"symbol": symbol, "venue": "BINANCE", "kind": "spot", "currency": found["quoteAsset"], "priceExp": _decimals(tick), "qtyExp": _decimals(lot), "tickSize": tick.rstrip("0").rstrip("."), "lotSize": lot.rstrip("0").rstrip("."), "pointValue": "1", "accounting": "cash"}


def describe_candles(body: bytes) -> dict:
    """The same from a product record of the other venue."""
    found = json.loads(body, parse_float=str)
    try:
        tick, lot = found["quote_increment"], found["base_increment"]
        return {"symbol": found["id"], "venue": "COINBASE", "kind": "spot", "currency": found["quote_currency"], "priceExp": _decimals(tick), "qtyExp": _decimals(lot), "tickSize": tick, "lotSize": lot, "pointValue": "1", "accounting": "cash"}
    except KeyError as e:
        raise DataError(f"no {e.args[0]} in the product record") from None


def frames(texts: DataFrame, symbol: str, text: str = "value") -> DataFrame:
    """A stream's (or a table's) frames with kind (bar, tick, ignored or malformed; only closed candles of the symbol are bars) and the fields of bars (open_ts, close_ts, open, high, low,
    close, volume) and ticks (ts, price, size, aggressor), prices as text. Counting kinds gives the feed's counters."""
    # Names of fields differ by their case only, so they are read by path.
    rows = texts.withColumn("_f", F.coalesce(F.get_json_object(text, "$.data"), F.col(text)))
    field = lambda path: F.get_json_object("_f", f"$.{path}")
    e, own = field("e"), field("s") == symbol
    candle = F.when(~own | (field("k.x") == "false"), "ignored").when(field("k.t").isNull() | field("k.T").isNull() | field("k.c").isNull(), "malformed").otherwise("bar")
    trade = F.when(~own, "ignored").when(field("T").isNull() | field("p").isNull() | field("q").isNull(), "malformed").otherwise("tick")
    kind = F.when(e.isNull() | ((e == "kline") & (field("k").isNull() | field("s").isNull())), "malformed").when(e == "kline", candle).when(e == "aggTrade", trade).otherwise("ignored")
    rows = rows.withColumn("kind", kind)
    bar, tick = F.col("kind") == "bar", F.col("kind") == "tick"
    return rows.select(
        *texts.columns, "kind", F.when(bar, field("k.t").cast("long") * 1_000).alias("open_ts"), F.when(bar, (field("k.T").cast("long") + 1) * 1_000).alias("close_ts"), *(F.when(bar, field(f"k.{x}")).alias(n) for x, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)),
        F.when(tick, field("T").cast("long") * 1_000).alias("ts"), F.when(tick, field("p")).alias("price"), F.when(tick, field("q")).alias("size"), F.when(tick, F.when(field("m") == "true", -1).otherwise(1)).alias("aggressor"),
    )


def frame(text: str, symbol: str) -> tuple[str, tuple | None]:
    """What a stream's frame is (bar, tick, ignored or malformed) and its row, prices as text: only closed candles of the symbol are bars."""
    try:
        data = json.loads(text)
        data = data["data"] if isinstance(data, dict) and "stream" in data else data
        kind = data["e"]
        if kind == "kline":
            k = data["k"]
            if data["s"] != symbol or k["x"] is False:
                return "ignored", None
            return "bar", (symbol, int(k["t"]) * 1_000, (int(k["T"]) + 1) * 1_000, *(str(k[x]) for x in "ohlcv"))
        if kind == "aggTrade":
            if data["s"] != symbol:
                return "ignored", None
            # The buyer being the maker means that the seller took.
            return "tick", (symbol, int(data["T"]) * 1_000, str(data["p"]), str(data["q"]), -1 if data["m"] else 1)
        return "ignored", None
    except (ValueError, KeyError, TypeError, AttributeError):
        return "malformed", None


def bulletin_name(date) -> str:
    return f"PR{date:%y%m%d}.zip"


#: Elements of a price record (fixed values) and the fields that they fill.
RECORD = {"TckrSymb": "ticker", "Dt": "date", "FrstPric": "open", "MaxPric": "high", "MinPric": "low", "LastPric": "close", "AdjstdQt": "settlement", "FinInstrmQty": "volume", "OpnIntrst": "open_interest"}


def bulletin(data: bytes, wanted: set[str]) -> list[dict[str, str]]:
    """Records of the wanted tickers from a bulletin: an archive within an archive, of whose documents the last counts."""
    if not data:
        return []
    with zipfile.ZipFile(io.BytesIO(data)) as outer:
        inner = next(n for n in outer.namelist() if n.lower().endswith(".zip"))
        with zipfile.ZipFile(io.BytesIO(outer.read(inner))) as z:
            documents = [n for n in z.namelist() if n.lower().endswith(".xml")]
            if not documents:
                raise DataError("the bulletin holds no price report")
            if z.getinfo(documents[-1]).flag_bits & 1:
                raise DataError("the bulletin's report is encrypted")
            content = z.read(documents[-1])
    out = []
    for _, element in ElementTree.iterparse(io.BytesIO(content)):
        if element.tag.rpartition("}")[2] != "PricRpt":
            continue
        found = {RECORD[x.tag.rpartition("}")[2]]: (x.text or "").strip() for x in element.iter() if x.tag.rpartition("}")[2] in RECORD}
        if found.get("ticker", "").upper() in wanted:
            out.append(found)
        element.clear()
    return out


def bulletin_bars(records: list[dict[str, str]], open_ts: int, close_ts: int, settlement: bool = False) -> list[tuple]:
    """Bars (SCHEMA) of a session; a contract that only settled has none."""
    out = []
    for r in records:
        close = (r.get("settlement") or r.get("close")) if settlement else r.get("close")
        if all((r.get("open"), r.get("high"), r.get("low"), close)):
            out.append((r["ticker"], open_ts, close_ts, r["open"], r["high"], r["low"], close, r.get("volume") or "0"))
    return out


class Session(InputPartition):
    def __init__(self, url: str, open_ts: int, close_ts: int):
        super().__init__(url)
        self.url, self.open_ts, self.close_ts = url, open_ts, close_ts


class BulletinReader(DataSourceReader):
    """A partition for each session: ``sessions`` is a list of [date, open_ts, close_ts] as JSON, ``tickers`` a comma-separated list."""

    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[Session]:
        base = self.o["base"].rstrip("/")
        return [Session(f"{base}/{bulletin_name(dt.date.fromisoformat(day))}", a, z) for day, a, z in json.loads(self.o["sessions"])]

    def read(self, session: Session) -> Iterator[tuple]:
        fetch = fetch_url
        if named := self.o.get("fetch"):
            module, _, name = named.partition(":")
            fetch = getattr(importlib.import_module(module), name)
        # A session without a bulletin, as on days that turned out to be holidays, has no bars.
        missing = lambda url: (200, {}, b"") if (got := fetch(url))[0] == 404 else got
        found = bulletin(with_retries(missing, session.url), {t.strip().upper() for t in self.o["tickers"].split(",")})
        yield from bulletin_bars(found, session.open_ts, session.close_ts, self.o.get("settlement") == "true")


class BulletinSource(DataSource):
    """``spark.read.format("bulletin")`` with options base, sessions, tickers and settlement; prices stay text."""

    @classmethod
    def name(cls) -> str:
        return "bulletin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BulletinReader:
        return BulletinReader(self.options)
