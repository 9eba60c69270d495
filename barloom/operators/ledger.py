"""Ledgers from fills: cash, positions, equity, trades, margin. Fills are (instrument, ts_us, seq, side, qty, price)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import fixed


def by_order(*keys: str):
    return Window.partitionBy(*(keys or ("instrument",))).orderBy("ts_us", "seq")


def running(fills: DataFrame, point_value: int, divisor: int, commission: int = 0) -> DataFrame:
    """fills with position and cash after each (cash accounting: a purchase pays its notional), cash from 0 on; commission by unit."""
    w = by_order().rowsBetween(Window.unboundedPreceding, 0)
    money = fixed.price_delta_to_money(F.col("price"), F.col("side") * F.col("qty"), point_value, divisor)
    rows = fills.withColumn("money", money).withColumn("commission", F.col("qty") * commission)
    return rows.withColumn("position", F.sum(F.col("side") * F.col("qty")).over(w)).withColumn("cash", F.sum(-F.col("money") - F.col("commission")).over(w))


def trade_ids(fills: DataFrame) -> DataFrame:
    """fills with before, position and trade: the number of the flat-to-flat stretch that a fill belongs to, from 1 on.

    A fill that turns the position over belongs to the trade that it ends; what it opens starts the next.
    """
    w = by_order()
    rows = fills.withColumn("position", F.sum(F.col("side") * F.col("qty")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("position") - F.col("side") * F.col("qty"))
    ends = (F.col("before") != 0) & ((F.col("position") == 0) | (F.signum("position") != F.signum("before")))
    rows = rows.withColumn("ends", ends)
    return rows.withColumn("trade", F.coalesce(F.sum(F.col("ends").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)


def trades(fills: DataFrame, point_value: int, divisor: int) -> DataFrame:
    """Closed trades: instrument, trade, direction, entry_ts, exit_ts, fills, gross (in money).

    Gross is what the trade's sales brought less what its purchases cost; a fill that turns the position counts with its part on each side.
    """
    rows = trade_ids(fills)
    turns = F.col("ends") & (F.col("position") != 0)
    parts = rows.select("*", F.explode(F.when(turns, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    qty = F.when(F.col("part") == 1, F.abs("position")).when(turns, F.abs("before")).otherwise(F.col("qty"))
    parts = parts.withColumn("part_qty", qty).withColumn("trade", F.col("trade") + F.col("part")).withColumn("closes", F.col("ends") & (F.col("part") == 0))
    money = fixed.price_delta_to_money(F.col("price"), F.col("side") * F.col("part_qty"), point_value, divisor)
    order = F.struct("ts_us", "seq")
    out = parts.withColumn("m", money).groupBy("instrument", "trade").agg(
        F.min_by("side", order).alias("direction"), F.min("ts_us").alias("entry_ts"), F.max("ts_us").alias("exit_ts"), F.count("*").alias("fills"), (-F.sum("m")).alias("gross"), F.max("closes").alias("closed")
    )
    return out.where("closed").drop("closed")


def _half_even(n: int, d: int) -> int:
    q, r = divmod(abs(n), d)
    q += 2 * r > d or 2 * r == d and q % 2
    return -q if n < 0 else q


def _half_up(n: int, d: int) -> int:
    q = (2 * abs(n) + d) // (2 * d)
    return -q if n < 0 else q


class Position:
    """Cost basis of one instrument, carried exactly: a part close releases its share, halves to even."""

    __slots__ = ("qty", "basis", "realised", "point_value", "divisor")

    def __init__(self, point_value: int, divisor: int):
        self.qty = self.basis = self.realised = 0
        self.point_value, self.divisor = point_value, divisor

    def money(self, price: int, qty: int) -> int:
        return _half_up(price * qty * self.point_value, self.divisor)

    def apply(self, side: int, qty: int, price: int) -> tuple[int, int, int]:
        """Quantity closed and opened, and what was realised."""
        signed = side * qty
        if self.qty == 0 or (self.qty > 0) == (signed > 0):
            self.basis += self.money(price, signed)
            self.qty += signed
            return 0, qty, 0
        closed = min(qty, abs(self.qty))
        released = _half_even(self.basis * closed, abs(self.qty)) if closed < abs(self.qty) else self.basis
        gained = self.money(price, closed if self.qty > 0 else -closed) - released
        self.basis -= released
        self.qty += side * closed
        self.realised += gained
        if rest := qty - closed:
            self.qty = side * rest
            self.basis = self.money(price, self.qty)
        return closed, rest, gained


def cost_basis(fills: DataFrame, point_value: int, divisor: int) -> DataFrame:
    """fills with position, basis, closed, opened and realised: recursive within a flat-to-flat trade, and each trade begins anew.

    Trades are dealt out and sorted; a worker reads them in batches and carries the position from one to the next, so
    neither an instrument nor a long trade is ever held whole. A fill that turns the position is split and put together again.
    """
    rows = trade_ids(fills).withColumn("_n", F.row_number().over(by_order()))
    turns = F.col("ends") & (F.col("position") != 0)
    parts = rows.withColumn("_turns", turns).withColumn("_part", F.explode(F.when(turns, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    qty = F.when(F.col("_part") == 1, F.abs("position")).when(F.col("_turns"), F.abs("before")).otherwise(F.col("qty")).cast("long")
    parts = parts.select(*fills.columns, "_n", "_part", (F.col("trade") + F.col("_part")).alias("_trade"), qty.alias("_qty"))
    made = ("position", "basis", "closed", "opened", "realised")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, p = None, Position(point_value, divisor)
        for frame in frames:
            out = []
            for key, side, n, price in zip(zip(frame["instrument"].tolist(), frame["_trade"].tolist(), strict=True), frame["side"].tolist(), frame["_qty"].tolist(), frame["price"].tolist(), strict=True):
                if key != own:
                    own, p = key, Position(point_value, divisor)
                closed, opened, gained = p.apply(side, n, price)
                out.append((p.qty, p.basis, closed, opened, gained))
            values = np.array(out, dtype=np.int64).reshape(len(frame), 5)
            yield frame.assign(**dict(zip(made, values.T, strict=True)))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema] + [f"{n} long" for n in made])
    done = parts.repartition("instrument", "_trade").sortWithinPartitions("instrument", "_trade", "_n").mapInPandas(run, schema)
    whole = done.groupBy("instrument", "_n").agg(F.first(F.struct(*fills.columns)).alias("_fill"), F.max_by(F.struct("position", "basis"), "_part").alias("_after"), *(F.sum(c).alias(c) for c in made[2:]))
    return whole.select("_fill.*", "_after.*", *made[2:])
