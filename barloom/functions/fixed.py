"""Exact fixed-point arithmetic as Column expressions.

Prices and quantities are long columns in units of 10^-exp; money is a long in units of 10^-8. Products go through DECIMAL(38, 0), so
they are exact; a result beyond 2^53 - 1 raises, as it could not be carried by the formats that the engine reads and writes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_EXP = 8
MONEY_ONE = 10**MONEY_EXP
MOST = 2**53 - 1
MODES = ("trunc", "floor", "ceil", "half-up", "half-even")


def wide(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def narrow(c: Column) -> Column:
    """A decimal as long, refused beyond MOST."""
    return F.when(F.abs(c) <= wide(MOST), c.cast("long")).when(c.isNull(), F.lit(None).cast("long")).otherwise(F.raise_error(F.concat(F.lit("beyond 53 bits: "), c.cast("string"))).cast("long"))


def _times(*factors: Column | int) -> Column:
    """Exact product. Spark types a product of decimals wider than it needs to be and then loses digits, so each
    step is cast back."""
    out = wide(factors[0])
    for f in factors[1:]:
        out = (out * wide(f).cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def divide(n: Column, d: Column | int, mode: str) -> Column:
    """n / d of decimals, rounded. ``half-up`` rounds halves away from zero, ``half-even`` to the even neighbour; d > 0."""
    if mode not in MODES:
        raise ValueError(f"no such rounding: {mode}")
    n, d = wide(n), wide(d)
    q = F.call_function("div", n, d).cast("decimal(38,0)")
    r = (n - (q * d).cast("decimal(38,0)")).cast("decimal(38,0)")
    sign = F.when(n < 0, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(38,0)")
    away = (q + sign).cast("decimal(38,0)")
    twice = (F.abs(r) * 2).cast("decimal(38,0)")
    if mode == "trunc":
        return q
    if mode == "floor":
        return F.when((r != 0) & (n < 0), away).otherwise(q)
    if mode == "ceil":
        return F.when((r != 0) & (n > 0), away).otherwise(q)
    if mode == "half-up":
        return F.when(twice >= d, away).otherwise(q)
    return F.when((twice > d) | ((twice == d) & (q % 2 != 0)), away).otherwise(q)


def mul_div(a, b, d, mode: str = "half-up") -> Column:
    """a * b / d."""
    return narrow(divide(_times(a, b), d, mode))


def mul_mul_div(a, b, c, d, mode: str = "half-up") -> Column:
    """a * b * c / d."""
    return narrow(divide(_times(a, b, c), d, mode))


def mul_div_div(a, b, d1, d2, mode: str = "half-even") -> Column:
    """a * b / (d1 * d2)."""
    return narrow(divide(_times(a, b), _times(d1, d2), mode))


def weighted_average(v1, w1, v2, w2) -> Column:
    """(v1 * w1 + v2 * w2) / (w1 + w2), halves to even; 0 where the weights are 0."""
    total = wide(w1) + wide(w2)
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(narrow(divide((_times(v1, w1) + _times(v2, w2)).cast("decimal(38,0)"), F.nullif(total, wide(0)), "half-even")))


def running_average(values: Column, weights: Column) -> Column:
    """The average of an array of values by weights as it is kept from one to the next: rounded, halves to even, at each step, so that the order matters. 0 without weight."""
    zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("w"))
    pairs = F.arrays_zip(values.alias("v"), weights.alias("w"))
    return F.aggregate(pairs, zero, lambda a, x: F.struct(weighted_average(a["v"], a["w"], x["v"], x["w"]).alias("v"), (a["w"] + x["w"]).cast("long").alias("w")), lambda a: a["v"])


def round_to_tick(v: Column, tick: Column | int, mode: str = "nearest") -> Column:
    """v to a multiple of tick: nearest (halves up), down, up or toward-zero."""
    tick = F.lit(tick).cast("long") if isinstance(tick, int) else tick
    over = F.pmod(v, tick)
    down = v - over
    up = F.when(over == 0, v).otherwise(down + tick)
    if mode == "down":
        return down
    if mode == "up":
        return up
    if mode == "toward-zero":
        return F.when(v >= 0, down).otherwise(up)
    if mode == "nearest":
        return F.when(over * 2 >= tick, up).otherwise(down)
    raise ValueError(f"no such rounding: {mode}")


def is_tick_aligned(v: Column, tick: Column | int) -> Column:
    return v % tick == 0


def parse_fixed(text: Column, exp: int) -> Column:
    """Decimal text as an integer of 10^-exp, further digits rounded half away from zero; null for anything else."""
    t = F.trim(text)
    good = t.rlike(r"^[+-]?\d+(\.\d+)?$")
    whole = F.regexp_extract(t, r"^[+-]?(\d+)", 1)
    frac = F.regexp_extract(t, r"\.(\d+)$", 1)
    kept = F.rpad(F.substring(frac, 1, exp), exp, "0") if exp else F.lit("")
    next_digit = F.when(F.char_length(frac) > exp, F.substring(frac, exp + 1, 1)).otherwise(F.lit("0"))
    size = F.concat(whole, kept).cast("decimal(38,0)") + F.when(next_digit >= "5", 1).otherwise(0)
    return F.when(good, narrow(F.when(t.startswith("-"), -size).otherwise(size).cast("decimal(38,0)")))


def format_fixed(v: Column, exp: int) -> Column:
    """The integer as text with exactly exp decimals."""
    if exp == 0:
        return v.cast("string")
    digits = F.lpad(F.abs(v).cast("string"), exp + 1, "0")
    long = F.char_length(F.abs(v).cast("string")) > exp + 1
    digits = F.when(long, F.abs(v).cast("string")).otherwise(digits)
    n = F.char_length(digits)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.substring(digits, F.lit(1), n - exp), F.lit("."), F.substring(digits, n - exp + 1, F.lit(exp)))


def js_round(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + 0.5)


def significant(x: Column, digits: int = 12) -> Column:
    """x at so many significant digits; null where it is not finite; never minus zero."""
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.format_string(f"%.{digits - 1}e", x).cast("double") + 0.0)


def notional(price, qty, point_value, divisor) -> Column:
    """Money of a trade, without its sign; halves away from zero."""
    return F.abs(mul_mul_div(price, qty, point_value, divisor, "half-up"))


def price_delta_to_money(delta, qty, point_value, divisor) -> Column:
    return mul_mul_div(delta, qty, point_value, divisor, "half-up")
