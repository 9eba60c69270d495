"""Trading calendars, futures contracts and continuous series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import lookups

MINUTE = times.MICROS["m"]


@dataclass(frozen=True)
class Calendar:
    """When a venue trades, in local time at a fixed offset: weekend days (0 is Sunday), sessions (name, open and close minute), holidays by
    month-day and by days from Easter, and single days closed or with other sessions."""

    offset_minutes: int = 0
    weekend: tuple[int, ...] = ()
    sessions: tuple[tuple[str, int, int], ...] = (("continuous", 0, 1440),)
    holidays: tuple[str, ...] = ()
    easter: tuple[int, ...] = ()
    special: dict[str, tuple[tuple[str, int, int], ...]] = field(default_factory=dict)
    valid_from: str | None = None


ALWAYS_OPEN = Calendar()
#: The Brazilian exchange (fixed values).
B3 = Calendar(-180, (0, 6), (("regular", 540, 1080),), ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "11-20", "12-24", "12-25", "12-31"), (-48, -47, -2, 60), {}, "2019-11-03")


def sessions(spark: SparkSession, calendar: Calendar, first: str, last: str) -> DataFrame:
    """date, day (days since 1970), midnight (when the local day begins), name, open_ts, close_ts of each session of the local days from first to last."""
    if calendar.valid_from and first < calendar.valid_from:
        raise ValueError(f"the calendar holds from {calendar.valid_from} on")
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    shut = F.lit(False)
    if calendar.weekend:
        shut = shut | times.weekday(F.col("date")).isin(*calendar.weekend)
    if calendar.holidays:
        shut = shut | F.date_format("date", "MM-dd").isin(*calendar.holidays)
    for days_off in calendar.easter:
        shut = shut | (F.date_sub("date", days_off) == times.easter(F.year("date")))
    usual = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(z).alias("z")) for n, a, z in calendar.sessions))
    own = F.when(shut, F.slice(usual, 1, 0)).otherwise(usual)
    for day, hours in calendar.special.items():
        other = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(z).alias("z")) for n, a, z in hours)) if hours else F.slice(usual, 1, 0)
        own = F.when(F.col("date") == F.to_date(F.lit(day)), other).otherwise(own)
    rows = days.withColumn("s", F.explode(own)).withColumn("day", F.unix_date("date"))
    at = lambda m: F.col("day").cast("long") * times.DAY + ((F.col(m) if isinstance(m, str) else m) - calendar.offset_minutes).cast("long") * MINUTE
    return rows.select("date", "day", at(F.lit(0)).alias("midnight"), "s.name", at("s.a").alias("open_ts"), at("s.z").alias("close_ts"))


def trading_days(s: DataFrame) -> DataFrame:
    """date and n: the days with a session, numbered. A calendar has some 250 rows a year, so one task numbers them."""
    return s.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))


def next_close(left: DataFrame, s: DataFrame, ts: str) -> DataFrame:
    """left with next_close: the first session close after ts on its local day; if that has none left, the last close of the next trading day."""
    days = s.groupBy("day").agg(F.max("close_ts").alias("_last"))
    found = lookups.step(left, s.join(days, "day").select("close_ts", "midnight", "_last"), F.col(ts), "close_ts", ["close_ts", "midnight", "_last"], times.DAY)
    return found.select(*left.columns, F.when(F.col(ts) >= F.col("midnight"), F.col("close_ts")).otherwise(F.col("_last")).alias("next_close"))


def next_open(left: DataFrame, s: DataFrame, ts: str) -> DataFrame:
    """left with next_open: ts itself within a session, else the next session's open."""
    found = lookups.step(left, s.select("close_ts", F.col("open_ts").alias("_open")), F.col(ts), "close_ts", ["_open"], times.DAY)
    return found.withColumn("next_open", F.greatest("_open", F.col(ts))).withColumn("next_open", F.when(F.col("_open").isNotNull(), F.col("next_open"))).drop("_open")


def is_open(left: DataFrame, s: DataFrame, ts: str) -> DataFrame:
    """left with is_open: whether a session holds ts."""
    return lookups.step(left, s, F.col(ts), "close_ts", ["open_ts"], times.DAY).withColumn("is_open", F.coalesce(F.col("open_ts") <= F.col(ts), F.lit(False))).drop("open_ts")


MONTH_CODES = "FGHJKMNQUVXZ"


@dataclass(frozen=True)
class Series:
    root: str
    months: tuple[int, ...]
    expiry: str
    roll_days: int
    day: int = 0


#: Index and dollar futures (fixed values): months, rule of expiry, trading days between roll and expiry.
SERIES = {
    "WIN": Series("WIN", (2, 4, 6, 8, 10, 12), "wednesday-nearest-15th", 5),
    "IND": Series("IND", (2, 4, 6, 8, 10, 12), "wednesday-nearest-15th", 5),
    "WDO": Series("WDO", tuple(range(1, 13)), "first-trading-day", 3),
    "DOL": Series("DOL", tuple(range(1, 13)), "first-trading-day", 3),
}


def symbol(root: str, year, month):
    return F.concat(F.lit(root), F.substring(F.lit(MONTH_CODES), month, F.lit(1)), F.lpad((year % 100).cast("string"), 2, "0"))


def parse_symbol(text, pivot: int):
    """root, year and month of a contract symbol; the year is that within 50 years of the pivot."""
    two = F.regexp_extract(text, r"(\d{2})$", 1).cast("int")
    year = two + pivot // 100 * 100
    year = F.when(year - pivot > 50, year - 100).when(pivot - year >= 50, year + 100).otherwise(year)
    return F.regexp_extract(text, r"^([A-Z]+)[FGHJKMNQUVXZ]\d{2}$", 1), year, F.instr(F.lit(MONTH_CODES), F.regexp_extract(text, r"([FGHJKMNQUVXZ])\d{2}$", 1))


def contracts(s: DataFrame, series: Series, first_year: int, last_year: int) -> DataFrame:
    """symbol, root, year, month, expiry, rolls_at (closes in microseconds) of the contracts whose months lie within the years; the sessions must reach further."""
    spark = s.sparkSession
    months = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.array(*(F.lit(m) for m in series.months))).alias("month"))
    day = lambda n: F.make_date("year", "month", F.lit(n))
    backward = series.expiry == "last-trading-day"
    if series.expiry == "wednesday-nearest-15th":
        ahead = F.pmod(3 - times.weekday(day(15)), F.lit(7))
        base = F.date_add(day(15), F.when(ahead <= 3, ahead).otherwise(ahead - 7))
    elif series.expiry == "first-trading-day":
        base = day(1)
    elif backward:
        base = F.last_day(day(1))
    else:
        base = day(series.day)
    numbered = trading_days(s).withColumn("d", F.col("date")).withColumn("_day", F.unix_date("date").cast("long"))
    found = lookups.step(months.withColumn("base", base), numbered, F.unix_date("base").cast("long"), "_day", ["d", "n"], 32, strict=False, backward=backward)
    closes = s.groupBy("date").agg(F.max("close_ts").alias("close_ts"))
    rolls = numbered.select((F.col("n") + series.roll_days).alias("n"), F.col("date").alias("roll_date"))
    out = found.join(closes.withColumnsRenamed({"date": "d", "close_ts": "expiry"}), "d").join(rolls, "n").join(closes.withColumnsRenamed({"date": "roll_date", "close_ts": "rolls_at"}), "roll_date")
    return out.select(symbol(series.root, F.col("year"), F.col("month")).alias("symbol"), F.lit(series.root).alias("root"), "year", "month", "expiry", "rolls_at")


def front(left: DataFrame, c: DataFrame, ts: str) -> DataFrame:
    """left with front: the contract that rolls next after ts."""
    return lookups.step(left, c.select("rolls_at", F.col("symbol").alias("front")), F.col(ts), "rolls_at", ["front"], times.DAY)


def roll_points(bars: DataFrame, c: DataFrame, roll_on: str = "rule") -> DataFrame:
    """Segments of a continuous series: symbol, after and until (closes, until included), and for all but the last to, trigger, gap and ratio to the next.

    bars are (instrument, close_ts, close, volume) with a contract's symbol as instrument; contracts without bars are left out, and so is one whose roll
    comes before its predecessor's. Bars are reduced to a row or two for each contract; only contracts, a few for each year, are put in one order.
    """
    line = Window.orderBy("expiry", "symbol")
    have = bars.select(F.col("instrument").alias("symbol")).distinct()
    order = c.select("symbol", "expiry", "rolls_at").join(have, "symbol").withColumn("to", F.lead("symbol").over(line))
    limits = order.select("symbol", "to", "expiry", F.col("rolls_at").alias("roll"), F.lit("rule").alias("trigger"))
    if roll_on == "volume":
        pairs = order.where("to is not null").select(F.col("symbol").alias("one"), F.col("to").alias("two"))
        sides = [bars.join(lookups.small(pairs), bars["instrument"] == pairs[k]).select("one", "two", "close_ts", "volume") for k in ("one", "two")]
        crossed = lookups.first_crossing(*sides, ["one", "two"]).select(F.col("one").alias("symbol"), "ts")
        limits = limits.join(crossed, "symbol", "left").select("symbol", "to", "expiry", F.coalesce("ts", "roll").alias("roll"), F.when(F.col("ts").isNotNull(), "volume").otherwise("rule").alias("trigger"))
    side = lookups.small(limits.select(F.col("symbol").alias("instrument"), "roll"))
    ends = bars.join(side, "instrument").where("close_ts <= roll").groupBy(F.col("instrument").alias("symbol")).agg(F.max("close_ts").alias("end"))
    rows = limits.join(ends, "symbol", "left").withColumn("before", F.max(F.when(F.col("to").isNotNull(), F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    kept = rows.where(F.col("to").isNull() | (F.col("end") > F.coalesce("before", F.lit(-(2**62)))))
    cut = kept.select("symbol", "expiry", F.col("before").alias("after"), F.when(F.col("to").isNotNull(), F.col("end")).alias("until"), "to", F.when(F.col("to").isNotNull(), F.col("trigger")).alias("trigger"))
    closes = bars.select(F.col("instrument").alias("_i"), F.col("close_ts").alias("_t"), F.col("close").alias("_c"))
    wanted = cut.where("until is not null").select(F.explode(F.array("symbol", "to")).alias("_i"), F.col("until").alias("_t")).distinct()
    at = closes.join(lookups.small(wanted), ["_i", "_t"])
    own, other = (at.select(F.col("_i").alias(k), F.col("_t").alias("until"), F.col("_c").alias(v)) for k, v in (("symbol", "_own"), ("to", "_other")))
    out = cut.join(own, ["symbol", "until"], "left").join(other, ["to", "until"], "left")
    gap = F.when(F.col("until").isNotNull(), F.coalesce(F.col("_other") - F.col("_own"), F.lit(0)))
    ratio = F.when(F.col("_own") == 0, 1.0).otherwise((F.col("_own") + F.col("gap")) / F.nullif(F.col("_own"), F.lit(0)))
    return out.withColumn("gap", gap).select("symbol", "expiry", "after", "until", "to", "trigger", "gap", F.when(F.col("until").isNotNull(), ratio).alias("ratio"))


def continuous(bars: DataFrame, segments: DataFrame, method: str = "difference") -> DataFrame:
    """The contracts' bars as one series, older ones moved on to the newest: by sums of gaps, by products of ratios, or not (none)."""
    if method not in ("difference", "ratio", "none"):
        raise ValueError(f"no such method: {method}")
    newer = Window.orderBy(F.col("expiry").desc(), F.col("symbol").desc()).rowsBetween(Window.unboundedPreceding, 0)
    moved = segments.select(F.col("symbol").alias("instrument"), "after", "until", F.sum(F.coalesce("gap", F.lit(0))).over(newer).alias("shift"), F.exp(F.sum(F.log(F.coalesce("ratio", F.lit(1.0)))).over(newer)).alias("scale"))
    inside = bars.join(lookups.small(moved), "instrument").where("(after is null or close_ts > after) and (until is null or close_ts <= until)")
    move = {"difference": lambda p: p + F.col("shift"), "ratio": lambda p: F.floor(p * F.col("scale") + 0.5).cast("long"), "none": lambda p: p}[method]
    return inside.select("instrument", "open_ts", "close_ts", *(move(F.col(p)).alias(p) for p in ("open", "high", "low", "close")), "volume")
