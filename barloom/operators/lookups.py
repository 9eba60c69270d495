"""Joins in time: as-of, exact, interval, first crossing and next event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A key's line of time with more rows than that is cut into blocks of about as many.
MOST_LINE = 500_000


def _cuts(lines: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """k and bounds (times, ascending) of the keys whose lines are to be cut, and how many bounds each has; null if no line is. There are about as many bounds as the rows
    have multiples of MOST_LINE; they come from approximate quantiles, as wherever a line is cut, the results are the same."""
    spark, counts = lines.sparkSession, lines.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > MOST_LINE)
    long = counts.collect()
    if not long:
        return None
    most = max(r["n"] for r in long)
    parts = -(-most // MOST_LINE)
    side = F.broadcast(spark.createDataFrame(long, counts.schema).withColumnRenamed("k", "_k"))
    at = F.percentile_approx("t", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))
    # A shorter line takes every so many of the quantiles.
    every = F.greatest(F.lit(1), F.floor(F.lit(most) / F.first("n")))
    found = lines.join(side, F.col("k").eqNullSafe(F.col("_k"))).groupBy("k").agg(F.array_distinct(F.filter(at, lambda _, i: (i + 1) % every == 0)).alias("bounds"))
    rows = found.collect()
    return spark.createDataFrame(rows, found.schema), [len(r["bounds"]) for r in rows]


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """left with ``columns`` of the last row of right at or before it (forward: the first at or after; strict: not at it), null if there is none.

    Both sides are laid on one line of time and the last value is carried along: one shuffle on the key and one sort, whatever the
    number of matches. Rows of right with the same time must agree or be unique. Rows are counted first: long lines are cut into blocks of time that are sorted
    on their own, each beginning with the value that the blocks before it leave; only rows of one key and time stay together, however many.
    """
    held = F.struct(F.lit(1).alias("_"), *columns)
    # At equal times right comes first (backward) so that it is seen, or last if it must not be.
    place = 0 if not strict else 2
    a = left.select(F.struct(*left.columns).alias("row"), F.col(key).alias("k"), F.col(left_ts).alias("t"), F.lit(1).alias("o"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("h"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(right_ts).alias("t"), F.lit(place).alias("o"), held.alias("h"))
    both, by, order = a.unionByName(b), ["k"], [F.col("t").desc() if forward else F.col("t"), "o"]
    cuts = _cuts(both.select("k", "t"))
    if cuts is not None:
        both, by, order = _in_blocks(both, *cuts, forward), ["k", "block"], ["o >= 0", *order]
    w = Window.partitionBy(*by).orderBy(*(F.expr(x) if isinstance(x, str) else x for x in order)).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("h", F.last("h", ignorenulls=True).over(w)).where("row is not null")
    return out.select("row.*", *(F.col(f"h.{c}").alias(c) for c in columns))


def _in_blocks(both: DataFrame, cuts: DataFrame, sizes: list[int], forward: bool) -> DataFrame:
    """Rows of both with the number of their block, and for each block a row (o is -1) of what the blocks before it leave; dealt by key and block."""
    side = F.broadcast(cuts.withColumnRenamed("k", "_k"))
    # A block's number is that of the bounds at or before its times, found by halving.
    steps = F.array(*(F.lit(2**i) for i in range(max(sizes).bit_length() - 1, -1, -1)))
    number = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get("bounds", n + s - 1) <= F.col("t"), n + s).otherwise(n))
    rows = both.join(side, F.col("k").eqNullSafe(F.col("_k")), "left").withColumn("block", F.when(F.col("bounds").isNotNull(), number).otherwise(0))
    found = F.struct("t")
    ends = rows.where("h is not null and bounds is not null").groupBy("k", "block").agg((F.min_by("h", found) if forward else F.max_by("h", found)).alias("h"), F.first(F.size("bounds")).alias("last"))
    w = Window.partitionBy("k").orderBy("block")
    if forward:
        ends = ends.withColumn("from", F.coalesce(F.lag("block").over(w), F.lit(0))).withColumn("to", F.col("block") - 1)
    else:
        ends = ends.withColumn("from", F.col("block") + 1).withColumn("to", F.coalesce(F.lead("block").over(w), F.col("last")))
    carried = ends.where("from <= to").select("k", "h", F.explode(F.sequence("from", "to")).alias("block"), F.lit(-1).alias("o"))
    dealt = max(sum(n + 1 for n in sizes), int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("row", "k", "t", "o", "h", "block").unionByName(carried, allowMissingColumns=True).repartition(dealt, "k", "block")


#: A side of at most so many rows may be broadcast.
MOST_SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(MOST_SMALL + 1).count() <= MOST_SMALL else df


def step(left: DataFrame, points: DataFrame, ts: Column, at: str, columns: list[str], width: int, strict: bool = True, backward: bool = False) -> DataFrame:
    """left with ``columns`` of the first of a few points after ts (not strict: at or after it; backward: the last before it), null if there is none.

    Points are a step function of time with unique times. Its cells of ``width`` hold their points and the next point beyond them, so that each row finds
    its own by the number of its cell, an equality; rows are not sorted, and no key holds them all.
    """
    ends = points.agg(F.min(at).alias("a"), F.max(at).alias("z")).first()
    if ends.a is None:
        return left.select("*", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in columns))
    cell = lambda c: F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))
    first, last = (v // width for v in (ends.a, ends.z))
    held = points.groupBy(cell(F.col(at)).alias("_cell")).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), *columns))).alias("_own"))
    cells = points.sparkSession.range(first, last + 1).select(F.col("id").alias("_cell")).join(held, "_cell", "left")
    # The cells are as many as the points' span has; one task lays the next point beyond over them.
    beyond = Window.orderBy(F.col("_cell").desc() if not backward else F.col("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    outer = F.last(F.element_at("_own", -1 if backward else 1), ignorenulls=True).over(beyond)
    cells = cells.select("_cell", "_own", outer.alias("_next"))
    after = {(True, False): lambda p, t: p["_at"] > t, (False, False): lambda p, t: p["_at"] >= t, (True, True): lambda p, t: p["_at"] < t, (False, True): lambda p, t: p["_at"] <= t}[strict, backward]
    # Times outside the span look from its edge: the points there are all before or all after them.
    rows = left.withColumn("_t", ts).withColumn("_cell", F.greatest(F.lit(first), F.least(F.lit(last), cell(F.col("_t")))))
    met = rows.join(small(cells), "_cell", "left")
    inside = F.filter("_own", lambda p: after(p, F.col("_t")))
    chosen = F.coalesce(F.get(inside, F.size(inside) - 1 if backward else F.lit(0)), F.when(after(F.col("_next"), F.col("_t")), F.col("_next")))
    return met.withColumn("_p", chosen).select(*left.columns, *(F.col(f"_p.{c}").alias(c) for c in columns))


def exact(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """left with columns of the row of right that has the same keys."""
    return left.join(right.select(*keys, *columns), keys, "left")


def within(left: DataFrame, sessions: DataFrame, ts: Column, day: Column, columns: list[str]) -> DataFrame:
    """left with columns of the session [open_ts, close_ts) that holds it, null outside; sessions have the day that they are on.

    The day is an equality, so each row meets only its day's sessions.
    """
    s = sessions.select(F.col("day").alias("_day"), F.col("open_ts").alias("_open"), F.col("close_ts").alias("_close"), *columns)
    hit = (day == F.col("_day")) & (ts >= F.col("_open")) & (ts < F.col("_close"))
    return left.join(s, hit, "left").drop("_day", "_open", "_close")


def first_crossing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ts: the first common close at which b's volume exceeds a's."""
    both = a.select(*keys, "close_ts", F.col("volume").alias("va")).join(b.select(*keys, "close_ts", F.col("volume").alias("vb")), [*keys, "close_ts"])
    return both.where("vb > va").groupBy(*keys).agg(F.min("close_ts").alias("ts"))
