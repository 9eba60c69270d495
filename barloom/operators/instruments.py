"""What is traded and what trading costs: instrument specifications as data, and cost models put together from columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.errors import ConfigError
from barloom.functions import fixed
from barloom.operators import orders

KINDS = ("spot", "future", "stock")
_DECIMAL = re.compile(r"[+-]?\d+(\.\d+)?")


@dataclass(frozen=True)
class Instrument:
    """Scales are exponents of ten; tick and lot are in units of them, money in 10^-8."""

    symbol: str
    price_exp: int = 0
    qty_exp: int = 0
    tick: int = 1
    lot: int = 1
    point_value: int = 10**8
    accounting: str = "margin"
    initial_margin: int = 0
    kind: str = "future"
    venue: str = ""
    currency: str = ""

    @property
    def divisor(self) -> int:
        return 10 ** (self.price_exp + self.qty_exp)

    @property
    def key(self) -> str:
        return f"{self.venue}:{self.symbol}"


#: The fields of a specification, decimals as text: presets by symbol (fixed values).
SPECS = {
    "WIN": {"symbol": "WIN", "venue": "B3", "kind": "future", "currency": "BRL", "priceExp": 0, "qtyExp": 0, "tickSize": "5", "lotSize": "1", "pointValue": "0.20", "accounting": "margin", "initialMargin": "1000"},
    "WDO": {"symbol": "WDO", "venue": "B3", "kind": "future", "currency": "BRL", "priceExp": 1, "qtyExp": 0, "tickSize": "0.5", "lotSize": "1", "pointValue": "10", "accounting": "margin", "initialMargin": "1500"},
    "BTCUSDT": {"symbol": "BTCUSDT", "venue": "BINANCE", "kind": "spot", "currency": "USDT", "priceExp": 2, "qtyExp": 5, "tickSize": "0.01", "lotSize": "0.00001", "pointValue": "1", "accounting": "cash"},
}


def stock(symbol: str) -> dict:
    """A share on the Brazilian exchange."""
    return {"symbol": symbol, "venue": "B3", "kind": "stock", "currency": "BRL", "priceExp": 2, "qtyExp": 0, "tickSize": "0.01", "lotSize": "1", "pointValue": "1", "accounting": "cash"}


def resolve(spec: dict) -> Instrument:
    """An instrument from its specification; what cannot be right is refused by name."""
    symbol = str(spec.get("symbol", "")).strip()
    if not symbol:
        raise ConfigError("an instrument's symbol must not be empty")
    for name in ("priceExp", "qtyExp"):
        if not isinstance(spec.get(name), int) or not 0 <= spec[name] <= 15:
            raise ConfigError(f"{symbol}: {name} must be a whole number from 0 to 15")
    if spec["priceExp"] + spec["qtyExp"] > 15:
        raise ConfigError(f"{symbol}: priceExp and qtyExp are too large together")
    if spec.get("kind") not in KINDS:
        raise ConfigError(f"{symbol}: kind must be one of {', '.join(KINDS)}")

    def decimal(name: str, exp: int, default: str | None = None) -> int:
        text = str(spec.get(name, default))
        if not _DECIMAL.fullmatch(text):
            raise ConfigError(f"{symbol}: {name} must be a decimal, not {text!r}")
        return orders._decimal(text, exp)

    sizes = {"tick": decimal("tickSize", spec["priceExp"]), "lot": decimal("lotSize", spec["qtyExp"]), "point_value": decimal("pointValue", fixed.MONEY_EXP)}
    for name, v in sizes.items():
        if v <= 0:
            raise ConfigError(f"{symbol}: {name} must be positive at the instrument's scale")
    accounting = spec.get("accounting") or ("margin" if spec["kind"] == "future" else "cash")
    return Instrument(symbol, spec["priceExp"], spec["qtyExp"], **sizes, accounting=accounting, initial_margin=decimal("initialMargin", fixed.MONEY_EXP, "0"), kind=spec["kind"], venue=spec.get("venue", ""), currency=spec.get("currency", ""))


def registry(specs: list[dict]) -> dict[str, Instrument]:
    """Instruments by venue and symbol; a key twice is refused."""
    out: dict[str, Instrument] = {}
    for spec in specs:
        own = resolve(spec)
        if own.key in out:
            raise ConfigError(f"{own.key} is registered already")
        out[own.key] = own
    return out


def load(text: str) -> Instrument:
    """A preset's name, or a file with a specification as JSON."""
    return resolve(SPECS[text] if text in SPECS else json.loads(Path(text).read_text()))


def resolved(specs: DataFrame) -> DataFrame:
    """A table of specifications (symbol, venue, kind, price_exp, qty_exp, tick_size, lot_size, point_value as text) with key, tick, lot, point, divisor and
    error: the first thing that cannot be right, null for a sound row."""
    at = lambda c, exp: F.when(F.col(c).rlike(r"^[+-]?\d+(\.\d+)?$"), F.round(F.col(c).cast("decimal(38,18)") * F.pow(F.lit(10), exp).cast("decimal(20,0)"), 0).cast("long"))
    rows = specs.withColumn("key", F.concat_ws(":", "venue", F.trim("symbol"))).withColumn("tick", at("tick_size", F.col("price_exp"))).withColumn("lot", at("lot_size", F.col("qty_exp"))).withColumn("point", at("point_value", F.lit(fixed.MONEY_EXP)))
    sound = lambda c: F.coalesce(F.col(c).between(0, 15), F.lit(False))
    error = (
        F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", "symbol").when(~sound("price_exp"), "price_exp").when(~sound("qty_exp"), "qty_exp").when(F.col("price_exp") + F.col("qty_exp") > 15, "scale")
        .when(~F.coalesce(F.col("tick") > 0, F.lit(False)), "tick_size").when(~F.coalesce(F.col("lot") > 0, F.lit(False)), "lot_size").when(~F.coalesce(F.col("point") > 0, F.lit(False)), "point_value")
    )
    return rows.withColumn("divisor", F.pow(F.lit(10), F.col("price_exp") + F.col("qty_exp")).cast("long")).withColumn("error", error)


def decimals_of(text: Column) -> Column:
    """How many decimals a published increment has, zeros at its end left out: an instrument's scale."""
    return F.char_length(F.regexp_replace(F.regexp_extract(text, r"\.(\d*)$", 1), "0+$", ""))


def trim_zeros(text: Column) -> Column:
    """Decimal text without the zeros at its end."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def decimal_string(value: Column) -> Column:
    """A finite double as plain decimal text, never with an exponent; null for others."""
    text = trim_zeros(value.cast("decimal(38,18)").cast("string"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), text)


@dataclass(frozen=True)
class Costs:
    """How fills are charged. slippage: (model, amount) of ``orders.slippage``; commission: ("none",), ("per-unit", fee), ("bps", maker, taker, least), ("percent", maker, taker) or
    ("tariff", contract, options); participation: basis points of a bar's volume, 0 for no limit."""

    slippage: tuple[str, int] = ("none", 0)
    commission: tuple = ("none",)
    participation: int = 0

    def price(self, own: Instrument, price: Column, side: Column, taker: Column, bar_range: Column | None = None) -> Column:
        model, amount = self.slippage
        return orders.slippage(model, price, side, taker, own.tick, amount, bar_range)

    def fee(self, own: Instrument, worth: Column, qty: Column, taker: Column) -> Column:
        """Commission of a fill worth so much. worth should be a column of its own, as exact products are long expressions that must not be written into each other."""
        model, *x = self.commission
        if model == "none":
            return F.lit(0).cast("long")
        if model == "per-unit":
            return orders.commission_per_unit(qty, x[0], own.qty_exp)
        if model == "bps":
            return orders.commission_bps(worth, taker, *x)
        if model == "percent":
            return orders.commission_percent(worth, taker, *x)
        if model == "tariff":
            return orders.commission_tariff(qty, x[0], **(x[1] if len(x) > 1 else {}))
        raise ConfigError(f"no such commission: {model}")


#: Costs by venue (fixed values).
PRESETS = {
    "ideal": Costs(),
    "binanceSpot": Costs(("bps", 2), ("percent", "0.100", "0.100"), 1_000),
    "binanceSpotBnb": Costs(("bps", 2), ("percent", "0.075", "0.075"), 1_000),
    "coinbaseExchange": Costs(("bps", 2), ("percent", "0.40", "0.60"), 1_000),
    "b3Futures": Costs(("ticks", 1), ("tariff", "WIN", {"day_trade": True}), 500),
    "b3Stocks": Costs(("ticks", 1), ("bps", 3, 3, 0), 500),
    "stress": Costs(("bps", 15), ("percent", "0.100", "0.100"), 100),
}
#: The presets that belong to each venue, its own first (fixed values); those in ANYWHERE are neutral.
VENUE_PRESETS = {"binance": ("binanceSpot", "binanceSpotBnb"), "coinbase": ("coinbaseExchange",)}
ANYWHERE = ("stress", "ideal")


def presets_for(market: str) -> tuple[str, ...]:
    """The presets that a market, written venue-symbol, may be run under."""
    return (*VENUE_PRESETS.get(market.partition("-")[0], ()), *ANYWHERE)


def found(left: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """left with the columns of a registry's row of the same key, and known: whether there is one."""
    return left.join(table.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def required(left: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """As ``found``; a key that is not registered fails the query by name."""
    rows = found(left, table, key)
    return rows.where(F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not registered: "), F.col(key))).cast("boolean"))).drop("known")
