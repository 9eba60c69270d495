"""Orders as expressions: validation, slippage, commission, participation, liveness; matching is in ``barloom.operators.matching``."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.errors import ConfigError
from barloom.functions import fixed
from barloom.operators import bars as _bars

BPS = 10_000


def validation(qty: Column, kind: Column, limit: Column, stop: Column, tick: Column | int, lot: Column | int) -> Column:
    """The reason to refuse an order, the first that applies; null for a sound one."""
    needs_limit, needs_stop = kind.isin("limit", "stop_limit"), kind.isin("stop", "stop_limit")
    bad = lambda p: p.isNotNull() & ((p <= 0) | (p % tick != 0))
    return (
        F.when((qty <= 0) | (qty % lot != 0), "invalid_quantity")
        .when((needs_limit & limit.isNull()) | (needs_stop & stop.isNull()), "missing_price")
        .when((~needs_limit & limit.isNotNull()) | (~needs_stop & stop.isNotNull()) | bad(limit) | bad(stop), "invalid_price")
    )


def _worse(price: Column, offset: Column, side: Column, tick: Column | int) -> Column:
    """Price moved against the taker, and on to the next tick in that direction. side is 1 to buy and -1 to sell."""
    # In the taker's direction both sides round up; the offset is written as seldom as can be, since generated code grows with it.
    raw = price * side + offset
    return (raw + F.pmod(-raw, tick if isinstance(tick, Column) else F.lit(tick))) * side


def slippage(model: str, price: Column, side: Column, taker: Column, tick: Column | int, amount: int = 0, bar_range: Column | None = None) -> Column:
    """The price paid: models none, ticks (a number of ticks), bps (of the price) and range (bps of the bar's range). Makers pay none."""
    if model == "none" or amount == 0:
        return price
    if model == "ticks":
        paid = price + side * (tick * amount)
    elif model == "bps":
        paid = _worse(price, fixed.mul_div(price, amount, BPS, "ceil"), side, tick)
    elif model == "range":
        paid = F.when(bar_range == 0, price).otherwise(_worse(price, fixed.mul_div(bar_range, amount, BPS, "ceil"), side, tick))
    else:
        raise ValueError(f"no such slippage: {model}")
    return F.when(taker, paid).otherwise(price)


#: Commission of spot venues, in thousandths of a percent of the notional, for makers and takers (fixed values).
SPOT_FEES = {"binance": (100, 100), "binanceBnb": (75, 75), "coinbase": (400, 600)}
#: Exchange fees of index and dollar futures by contract in cents, their currency, and the percentage off for day trades (fixed values).
FUTURES_FEES = {"WIN": (30, "BRL", 35), "IND": (152, "BRL", 35), "WDO": (12, "USD", 16), "DOL": (60, "USD", 16)}


def commission_bps(notional: Column, taker: Column, maker_bps: int, taker_bps: int, least: int = 0) -> Column:
    """Basis points of the notional in money, halves away from zero, at least ``least``."""
    rate = F.when(taker, F.lit(taker_bps)).otherwise(F.lit(maker_bps)).cast("long")
    return F.greatest(fixed.mul_div(notional, rate, BPS, "half-up"), F.lit(least).cast("long"))


def commission_spot(notional: Column, taker: Column, venue: str) -> Column:
    maker, take = SPOT_FEES[venue]
    return fixed.mul_div(notional, F.when(taker, F.lit(take)).otherwise(F.lit(maker)).cast("long"), 100_000, "half-up")


def commission_percent(notional: Column, taker: Column, maker: str, take: str, least: str = "0") -> Column:
    """A share of the notional, given in percent as text, halves away from zero; at least ``least`` of money."""
    rates = [_decimal(x, 6) for x in (maker, take)]
    if min(rates) < 0:
        raise ConfigError("commission percent must not be negative")
    rate = F.when(taker, F.lit(rates[1])).otherwise(F.lit(rates[0])).cast("long")
    return F.greatest(fixed.mul_div(notional, rate, 100 * 10**6, "half-up"), F.lit(_decimal(least, 8)).cast("long"))


def tariff_per_contract(contract: str, day_trade: bool = False, brokerage: str = "0", usd_brl: str | None = None) -> int:
    """Money for each contract under the exchange's tariff: its fee, converted where it is in dollars, less the part off for day trades, and the broker's charge."""
    cents, currency, off = FUTURES_FEES[contract]
    if (currency == "USD") != (usd_brl is not None):
        raise ConfigError(f"{contract} is priced in {currency}: a rate of exchange belongs to fees in USD only")
    fee = cents * 10**6
    if usd_brl is not None:
        fee = _half_up(fee * _decimal(usd_brl, 8), 10**8)
    if day_trade:
        fee -= _half_up(fee * off, 100)
    total = fee + _decimal(brokerage, 8)
    if total < 0:
        raise ConfigError("costs must not be negative")
    return total


def commission_tariff(qty: Column, contract: str, **options) -> Column:
    return fixed.mul_div(qty, tariff_per_contract(contract, **options), 1, "half-up")


def qty_from_notional(notional: Column, price: Column, point_value: int, divisor: int, lot: int) -> Column:
    """The most whole lots that money buys at a price."""
    qty = fixed.mul_div(notional, divisor, F.nullif(price * point_value, F.lit(0)), "floor")
    return F.greatest(qty - F.pmod(qty, F.lit(lot)), F.lit(0))


def _decimal(text: str, exp: int) -> int:
    """Decimal text in units of 10^-exp, further digits rounded half away from zero."""
    try:
        return int(Decimal(text).scaleb(exp).quantize(Decimal(1), ROUND_HALF_UP))
    except ArithmeticError:
        raise ConfigError(f"not a decimal: {text!r}") from None


def _half_up(n: int, d: int) -> int:
    return (2 * n + d) // (2 * d)


def commission_per_unit(qty: Column, fee: int, qty_exp: int = 0) -> Column:
    return fixed.mul_div(qty, fee, 10**qty_exp, "half-up")


def participation(volume: Column, remaining: Column, bps: int, lot: Column | int) -> Column:
    """Most that a bar fills: a share of its volume in whole lots; all that remains where the volume is not known."""
    cap = fixed.mul_div(volume, bps, BPS, "floor")
    lots = cap - F.pmod(cap, lot if isinstance(lot, Column) else F.lit(lot))
    return F.when(volume <= 0, remaining).otherwise(F.least(remaining, lots))


def live(status: Column) -> Column:
    """Whether an order may still fill."""
    return status.isin("pending", "working", "partially_filled")


def jitter(price: Column, side: Column, taker: Column, tick: Column | int, most: int, *keys: Column) -> Column:
    """The price a taker pays moved against it by 0 to ``most`` whole ticks, drawn by a hash of the keys: repeatable, and independent of the order of rows."""
    return F.when(taker, price + side * tick * F.pmod(F.xxhash64(*keys, F.lit("jitter")), F.lit(most + 1))).otherwise(price)


def next_open(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Market orders (order_id, instrument, active_from) with fill_ts and price: the first bar that closes after they are active."""
    from barloom.operators.lookups import as_of

    b = bars.select("instrument", "close_ts", F.col("close_ts").alias("fill_ts"), F.col("open").alias("price"))
    return as_of(orders, b, "instrument", "active_from", "close_ts", ["fill_ts", "price"], forward=True, strict=True)


def crossover_targets(bars: DataFrame, fast: int, slow: int, qty: int, short: bool = True) -> DataFrame:
    """bars with ``target``: the position that a crossover of two moving averages wants after the bar.

    The averages are compared as integers, so that a tie is a tie; a tie keeps the side before it.
    """
    from barloom.operators.indicators import moving_sums

    sums = moving_sums(bars, {"_fast": fast, "_slow": slow})
    sided = sums.withColumn("_side", F.signum(F.col("_fast") * slow - F.col("_slow") * fast).cast("int"))
    sided = sided.withColumn("_held", F.last(F.nullif(F.col("_side"), F.lit(0)), ignorenulls=True).over(_bars.by_time().rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.when(F.col("_held") > 0, qty).when(F.col("_held") < 0, -qty if short else 0).otherwise(0)
    return sided.withColumn("target", wanted.cast("long")).drop("_fast", "_slow", "_side", "_held")
