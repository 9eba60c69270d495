"""Queries over records: newest rows, replaced rows, caps, totals over instruments, codes and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import fixed, times
from barloom.operators import futures, ledger
from barloom.plans.market import ORDER, TICKS, _rounded
from barloom.plans.registry import query
from barloom.plans.trading import DIVISOR, POINT, _basis, _cross, crossover
from barloom.sources import adapters


@query("SELECT o_orderkey AS run, epoch_us(o_orderdate) AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest runs, as a store lists them."""
    o = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), times.micros(F.col("o_orderdate")).alias("created_at"))
    return o.orderBy(F.desc("created_at"), F.desc("run")).limit(50)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Each key's newest row, as repeated writes leave it; a grouped maximum, which combines before it shuffles."""
    e = adapters.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query(f"WITH {_cross(4, 12, 10, 0, 0)}, s AS (SELECT instrument, close_ts, CASE WHEN target > 0 THEN 'long' WHEN target < 0 THEN 'short' ELSE 'flat' END AS direction, row_number() {ORDER}) AS n FROM run WHERE target <> position) SELECT * FROM s WHERE n <= 20")
def signals_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty signals of each instrument."""
    rows = crossover(adapters.hourly(spark, d), 4, 12, 10).where("target <> position")
    direction = F.when(F.col("target") > 0, "long").when(F.col("target") < 0, "short").otherwise("flat")
    n = F.row_number().over(Window.partitionBy("instrument").orderBy("close_ts"))
    return rows.select("instrument", "close_ts", direction.alias("direction"), n.alias("n")).where("n <= 20")


@query(f"WITH {_cross(8, 24, 10, 10, 15)} SELECT close_ts, count(*) AS instruments, CAST(sum(equity - 100000000000000) AS BIGINT) AS profit, CAST(sum(commission) AS BIGINT) AS commission FROM run GROUP BY 1")
def portfolio_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = crossover(adapters.hourly(spark, d), 8, 24, 10, 10, 15)
    return rows.groupBy("close_ts").agg(F.count("*").alias("instruments"), F.sum(F.col("equity") - 100_000_000_000_000).alias("profit"), F.sum("commission").alias("commission"))


@query(_basis(f"instrument, seq, CASE WHEN position <> 0 THEN {_rounded('abs(basis)', f'({POINT} * abs(position)::HUGEINT)', 'half-even')} END AS avg_entry"))
def avg_entry(spark: SparkSession, d: str) -> DataFrame:
    """The average entry price that a position's exact basis shows."""
    rows = ledger.cost_basis(adapters.fills(spark, d), POINT, DIVISOR)
    shown = fixed.mul_div_div(F.abs("basis"), DIVISOR, POINT, F.when(F.col("position") != 0, F.abs("position")))
    return rows.select("instrument", "seq", F.when(F.col("position") != 0, shown).alias("avg_entry"))


@query(f"WITH {TICKS} SELECT seq, ts_us // {times.DAY} AS day, ts_us // 1000 AS ms, strftime(make_timestamp(ts_us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, dayofweek(make_timestamp(ts_us)) AS weekday FROM ticks")
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    t = adapters.ticks(spark, d)
    ts = F.col("ts_us")
    return t.select("seq", times.day_index(ts).alias("day"), times.to_millis(ts).alias("ms"), times.to_iso(ts).alias("iso"), times.weekday(F.timestamp_micros(ts).cast("date")).cast("long").alias("weekday"))


@query("SELECT y AS year, m AS month, 'WIN' || substr('FGHJKMNQUVXZ', m, 1) || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS symbol, 'WIN' AS root, y AS parsed_year, m AS parsed_month FROM (SELECT unnest(generate_series(1990, 2060)) AS y), (SELECT unnest(generate_series(1, 12)) AS m) WHERE y > 1975 AND y <= 2075")
def contract_codes(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1990, 2061).select(F.col("id").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    rows = grid.withColumn("symbol", futures.symbol("WIN", F.col("year"), F.col("month")))
    root, year, month = futures.parse_symbol(F.col("symbol"), 2025)
    return rows.select("year", F.col("month").cast("long").alias("month"), "symbol", root.alias("root"), year.cast("long").alias("parsed_year"), month.cast("long").alias("parsed_month"))


@query("WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS z, count(*) AS n FROM orders GROUP BY 1) SELECT k AS range, epoch_us(a) AS from_ts, epoch_us(z) AS to_ts, n AS bar_count FROM c WHERE a <= TIMESTAMP '1997-01-01' AND z >= TIMESTAMP '1999-01-01' ORDER BY n, k LIMIT 1")
def smallest_covering(spark: SparkSession, d: str) -> DataFrame:
    """Of stored ranges the smallest that covers a query."""
    r = adapters.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("range")).agg(times.micros(F.min("o_orderdate")).alias("from_ts"), times.micros(F.max("o_orderdate")).alias("to_ts"), F.count("*").alias("bar_count"))
    covers = (F.col("from_ts") <= times.micros(F.lit("1997-01-01").cast("timestamp"))) & (F.col("to_ts") >= times.micros(F.lit("1999-01-01").cast("timestamp")))
    return r.where(covers).orderBy("bar_count", "range").limit(1)
