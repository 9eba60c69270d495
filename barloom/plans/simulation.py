"""Queries over strategies, brackets, calendars and continuous series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import bars as _bars
from barloom.operators import futures, matching, orders, runs, strategies
from barloom.operators.instruments import Costs, Instrument
from barloom.plans.market import BARS, ORDER, TICKS, _smooth, _TR
from barloom.plans.registry import query
from barloom.plans.trading import _cross, crossover
from barloom.sources import adapters

#: The instruments of the test data: event types.
SPOT = Instrument("", kind="spot", accounting="cash", point_value=10**6)
_NB = f"{BARS}, nb AS (SELECT *, row_number() {ORDER}) - 1 AS i FROM bars)"


@query(f"WITH {_cross(8, 24, 10, 10, 15)} SELECT 'sma-crossover/' || instrument || '/0' AS run, close_ts AS ts, CAST(equity + 900000000000000 AS BIGINT) AS equity FROM run")
def kernel_crossover(spark: SparkSession, d: str) -> DataFrame:
    """The equity curve of a run of the crossover strategy."""
    name = F.concat(F.lit("sma-crossover/"), "instrument", F.lit("/0"))
    return runs.equity(runs.run(adapters.hourly(spark, d), "sma-crossover", SPOT, Costs(("bps", 15), ("bps", 10, 10, 0)), name, fast=8, slow=24, qty=10))


_GRID = [(f, s) for f in (4, 8, 12) for s in (24, 36, 48)]


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_cross(f, s, 10, 10, 15)} SELECT {f} AS fast, {s} AS slow, instrument, count(*) FILTER (delta <> 0) AS fills, CAST(sum(commission) AS BIGINT) AS commission, arg_max(equity, close_ts) AS equity FROM run GROUP BY 3)" for f, s in _GRID))
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A grid of parameters: fills, commission and final equity of each run. All runs share one shuffle of the bars."""
    b = adapters.hourly(spark, d)
    parts = [crossover(b, f, s, 10, 10, 15).select(F.lit(f).alias("fast"), F.lit(s).alias("slow"), "*") for f, s in _GRID]
    return reduce(DataFrame.unionByName, parts).groupBy("fast", "slow", "instrument").agg(F.count_if(F.col("delta") != 0).alias("fills"), F.sum("commission").alias("commission"), F.max_by("equity", "close_ts").alias("equity"))


# Brackets around every tick: a long or short entry with a stop and a target, from the first bar that closes after it.
_ENTRIES = f"""{_NB}, en AS (SELECT t.seq, t.instrument, t.side, coalesce(b.i, -1) + 1 AS start, t.price - t.side * (seq % 97 + 5) * 30 AS stop, t.price + t.side * (seq % 89 + 5) * 30 AS target
  FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side FROM ticks) t ASOF LEFT JOIN nb b ON t.instrument = b.instrument AND t.ts_us >= b.close_ts)"""


def _bracketed(source: str) -> str:
    """CTEs for the bar that ends each bracket of source (seq, instrument, side, start, stop, target)."""
    return f"""lv AS (SELECT *, CASE WHEN side > 0 THEN stop ELSE target END AS below, CASE WHEN side > 0 THEN target ELSE stop END AS above FROM {source}),
    fi AS (SELECT lv.seq, lv.instrument, min(b.i) AS i FROM lv JOIN nb b ON b.instrument = lv.instrument AND b.i >= lv.start AND (b.low <= lv.below OR b.high >= lv.above) GROUP BY 1, 2),
    ex AS (SELECT lv.*, b.i AS exit_i, b.close_ts AS exit_ts, b.open AS bo, coalesce(b.low <= below AND b.high >= above, false) AS reached, b.open <= below AS at_low, b.open >= above AS at_high, b.low <= below AS is_low,
      b.open - b.low <= b.high - b.open AS path_low FROM lv LEFT JOIN fi USING (seq, instrument) LEFT JOIN nb b ON b.instrument = fi.instrument AND b.i = fi.i)"""


def _leg(policy: str) -> str:
    first = {"pessimistic": "side > 0", "optimistic": "side < 0", "ohlc-path": "path_low"}[policy]
    return f"CASE WHEN (CASE WHEN at_low THEN true WHEN at_high THEN false WHEN reached THEN {first} ELSE is_low END) = (side > 0) THEN 'stop' ELSE 'target' END"


_EXIT_PRICE = "CASE WHEN exit_i IS NULL THEN NULL WHEN leg = 'stop' THEN CASE WHEN side > 0 THEN least(stop, bo) ELSE greatest(stop, bo) END ELSE CASE WHEN side > 0 THEN greatest(target, bo) ELSE least(target, bo) END END"


def _policy_sql(policy: str) -> str:
    return f"SELECT '{policy}' AS policy, seq, exit_ts, leg, {_EXIT_PRICE} AS exit_price, ambiguous FROM (SELECT *, CASE WHEN exit_i IS NOT NULL THEN {_leg(policy)} END AS leg, reached AND NOT coalesce(at_low OR at_high, false) AS ambiguous FROM ex)"


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b, t = _bars.numbered(adapters.hourly(spark, d)), adapters.ticks(spark, d)
    side = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    rows = t.select("seq", "instrument", "ts_us", side.alias("side"), (F.col("price") - side * (F.col("seq") % 97 + 5) * 30).alias("stop"), (F.col("price") + side * (F.col("seq") % 89 + 5) * 30).alias("target"))
    return matching.placed(rows, b, "ts_us").drop("ts_us"), b


@query(f"WITH {_ENTRIES}, {_bracketed('en')} " + " UNION ALL ".join(_policy_sql(p) for p in matching.POLICIES))
def intrabar_policies(spark: SparkSession, d: str) -> DataFrame:
    """Every bracket under each policy for bars that reach both legs."""
    entries, b = _entries(spark, d)
    tables = matching.levels(b)
    parts = [matching.brackets(entries, b, tables, p).select(F.lit(p).alias("policy"), "seq", "exit_ts", "leg", "exit_price", "ambiguous") for p in matching.POLICIES]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"WITH {_ENTRIES}, {_bracketed('en')}, o AS ({_policy_sql('pessimistic')}) SELECT seq, leg AS filled, exit_ts AS filled_ts, exit_price AS price, CASE leg WHEN 'stop' THEN 'target' WHEN 'target' THEN 'stop' END AS cancelled, exit_ts AS cancelled_ts FROM o"
)
def oco_bracket(spark: SparkSession, d: str) -> DataFrame:
    """One cancels the other: of a stop and a target for each tick, which fills and which is cancelled when."""
    entries, b = _entries(spark, d)
    out = matching.brackets(entries, b, matching.levels(b))
    other = F.when(F.col("leg") == "stop", "target").when(F.col("leg") == "target", "stop")
    return out.select("seq", F.col("leg").alias("filled"), F.col("exit_ts").alias("filled_ts"), F.col("exit_price").alias("price"), other.alias("cancelled"), F.col("exit_ts").alias("cancelled_ts"))


def _stop_limit(policy: str) -> str:
    later = 1 if policy == "pessimistic" else 0
    passed = "CASE WHEN side > 0 THEN greatest(stop, b.open) ELSE least(stop, b.open) END"
    return f"""SELECT '{policy}' AS policy, s.seq, s.trigger_ts, b.close_ts AS fill_ts, CASE WHEN b.i IS NULL THEN NULL WHEN b.i = s.i THEN CASE WHEN side > 0 THEN least(lim, {passed}) ELSE greatest(lim, {passed}) END
      WHEN side > 0 THEN least(lim, b.open) ELSE greatest(lim, b.open) END AS price, {'true' if later else 'false'} AND coalesce(would, false) AS deferred FROM sl s LEFT JOIN (SELECT s.seq, min(b.i) AS i FROM sl s JOIN nb b ON b.instrument = s.instrument AND b.i >= s.i + {later}
      AND CASE WHEN side > 0 THEN b.low <= lim ELSE b.high >= lim END GROUP BY 1) f USING (seq) LEFT JOIN nb b ON b.instrument = s.instrument AND b.i = f.i"""


_STOPS = f"""{_NB}, so AS (SELECT t.seq, t.instrument, t.side, coalesce(b.i, -1) + 1 AS start, t.price + t.side * (seq % 50) * 30 AS stop, t.price + t.side * (seq % 50) * 30 + t.side * (seq % 7) * 10 AS lim
  FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side FROM ticks) t ASOF LEFT JOIN nb b ON t.instrument = b.instrument AND t.ts_us >= b.close_ts),
  tg AS (SELECT so.seq, min(b.i) AS i FROM so JOIN nb b ON b.instrument = so.instrument AND b.i >= so.start AND CASE WHEN side > 0 THEN b.high >= stop ELSE b.low <= stop END GROUP BY 1),
  sl AS (SELECT so.*, tg.i, b.close_ts AS trigger_ts, CASE WHEN side > 0 THEN b.low <= lim ELSE b.high >= lim END AS would FROM so LEFT JOIN tg USING (seq) LEFT JOIN nb b ON b.instrument = so.instrument AND b.i = tg.i)"""


@query(f"WITH {_STOPS} {_stop_limit('pessimistic')} UNION ALL {_stop_limit('optimistic')}")
def stop_limit_deferral(spark: SparkSession, d: str) -> DataFrame:
    """Stop-limit orders of every tick: when they trigger and fill, and whether the limit had to wait for the bar after the trigger."""
    side = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    o = adapters.ticks(spark, d).select("seq", "instrument", F.col("ts_us").alias("active_from"), side.alias("side"), (F.col("price") + side * (F.col("seq") % 50) * 30).alias("stop")).withColumn("limit", F.col("stop") + F.col("side") * (F.col("seq") % 7) * 10)
    b = adapters.hourly(spark, d)
    parts = [matching.stop_limits(o, b, p).select(F.lit(p).alias("policy"), "seq", "trigger_ts", "fill_ts", "price", "deferred") for p in ("pessimistic", "optimistic")]
    return reduce(DataFrame.unionByName, parts)


_CAPS = f"""{BARS}, cb AS (SELECT instrument, close_ts, open, greatest(volume, 0) * 1000 // 10000 // 2 * 2 AS cap FROM bars),
  cs AS (SELECT *, CAST(sum(cap) {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, CAST(sum(cap * open) {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM cb),
  o1 AS (SELECT t.seq, t.instrument, t.ts_us, t.seq % 400 + 1 AS qty, (t.ts_us // {times.DAY} + 1) * {times.DAY} AS ends, coalesce(b.s, 0) AS s0, coalesce(b.p, 0) AS p0 FROM ticks t ASOF LEFT JOIN cs b ON t.instrument = b.instrument AND t.ts_us >= b.close_ts),
  o2 AS (SELECT o1.*, coalesce(b.s, 0) AS s1 FROM o1 ASOF LEFT JOIN cs b ON o1.instrument = b.instrument AND o1.ends > b.close_ts),
  o3 AS (SELECT o2.*, coalesce(b.cap, 0) AS c1 FROM o2 ASOF LEFT JOIN cs b ON o2.instrument = b.instrument AND o2.ts_us < b.close_ts),
  o4 AS (SELECT o3.*, a.s AS sa, a.p AS pa FROM o3 JOIN (SELECT instrument, max(s) AS s, arg_max(p, close_ts) AS p FROM cs GROUP BY 1) a USING (instrument)),
  pos AS (SELECT * FROM cs WHERE cap > 0), o5 AS (SELECT o4.*, s0 + qty AS goal FROM o4), o6 AS (SELECT o5.*, b.close_ts AS done_ts, b.s AS sd, b.p AS pd, b.cap AS cd, b.open AS od FROM o5 ASOF LEFT JOIN pos b ON o5.instrument = b.instrument AND o5.goal <= b.s)"""


@query(f"WITH {_CAPS} SELECT seq, qty, CASE WHEN done_ts IS NOT NULL THEN qty ELSE sa - s0 END AS gtc, least(qty, greatest(s1 - s0, 0)) AS day, least(qty, c1) AS ioc, CASE WHEN c1 >= qty THEN qty ELSE 0 END AS fok, done_ts, CASE WHEN done_ts IS NOT NULL THEN pd - cd * od + (goal - sd + cd) * od - p0 ELSE pa - p0 END AS cost FROM o6")
def tif_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Market orders of every tick under a tenth of each bar's volume: what is filled by time in force, and when and at what cost the rest is."""
    t = adapters.ticks(spark, d).select("seq", "instrument", F.col("ts_us").alias("active_from"), (F.col("seq") % 400 + 1).alias("qty"))
    cap = orders.participation(F.greatest(F.col("volume"), F.lit(0)), F.lit(2**53 - 1), 1000, 2)
    ends = (times.day_index(F.col("active_from")) + 1) * times.DAY
    return matching.fills_in_time(t, adapters.hourly(spark, d), F.when(F.col("volume") > 0, cap).otherwise(0), ends).drop("instrument", "active_from")


# Strategies that are flat before they enter: candidates, of which those are kept that begin after the last one's exit.
_GREEDY = """g AS (SELECT c.* FROM cand c JOIN (SELECT instrument, min(i) AS i FROM cand GROUP BY 1) USING (instrument, i)
  UNION ALL SELECT c.* FROM (SELECT g.instrument, min(c.i) AS i FROM g JOIN cand c ON c.instrument = g.instrument AND c.i >= g.exit_i GROUP BY 1) m JOIN cand c USING (instrument, i))"""
_TRIPS = "SELECT instrument, entry_ts, exit_ts, entry_price, exit_price, CAST((exit_price - entry_price) * side * 5 * 1000000 AS BIGINT) AS gross, tag FROM g WHERE exit_ts IS NOT NULL"
_LEAD = f"lead(close_ts) {ORDER}) AS entry_ts, lead(open) {ORDER}) AS entry_price"


def _trips(bars: DataFrame, fills: DataFrame) -> DataFrame:
    """Closed trades with the tag of what ended them."""
    t = runs.closed_trades(bars, fills, SPOT).select("instrument", "entry_ts", "exit_ts", "entry_price", "exit_price", "gross")
    # An instrument has one exit at a time; prices may be null.
    ended = fills.where("tag <> 'entry'").select("instrument", F.col("ts_us").alias("exit_ts"), "tag")
    return t.join(ended, ["instrument", "exit_ts"])


_BREAKOUT = f"""WITH RECURSIVE {_NB}, t AS (SELECT instrument, close_ts, {_TR} AS tr FROM bars), {_smooth('e', 't', 'tr', 14, '1.0::DOUBLE / 14')},
  ch AS (SELECT nb.*, e.v AS atr, count(*) {ORDER} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS k, max(high) {ORDER} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS top, avg(volume) {ORDER} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS mv, {_LEAD} FROM nb LEFT JOIN e USING (instrument, close_ts)),
  en AS (SELECT i AS seq, instrument, 1 AS side, i + 2 AS start, entry_ts, entry_price, CAST(floor(entry_price - atr * 2 + 0.5) AS BIGINT) AS stop, CAST(floor(entry_price + atr * 3 + 0.5) AS BIGINT) AS target FROM ch
    WHERE k = 24 AND close > top AND NOT (mv > 0 AND volume < mv) AND atr > 0 AND entry_ts IS NOT NULL), {_bracketed('en')},
  cand AS (SELECT instrument, seq AS i, side, exit_i, entry_ts, entry_price, exit_ts, {_EXIT_PRICE} AS exit_price, leg AS tag FROM (SELECT *, CASE WHEN exit_i IS NOT NULL THEN {_leg('pessimistic')} END AS leg FROM ex)), {_GREEDY}"""


def _breakout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = adapters.hourly(spark, d)
    return b, strategies.breakout(b, SPOT, Costs(), lookback=24, volume=1.0, qty=5)


@query(f"{_BREAKOUT} {_TRIPS}")
def breakout_bracket(spark: SparkSession, d: str) -> DataFrame:
    return _trips(*_breakout(spark, d))


@query(f"{_BREAKOUT} SELECT instrument, count(*) AS entries, count(*) FILTER (tag = 'stop') AS stops, count(*) FILTER (tag = 'target') AS targets, count(*) FILTER (exit_ts IS NULL) AS open FROM g GROUP BY 1")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """How the entries of each run ended."""
    _, fills = _breakout(spark, d)
    n = lambda tag: F.count_if(F.col("tag") == tag)
    return fills.groupBy("instrument").agg(n("entry").alias("entries"), n("stop").alias("stops"), n("target").alias("targets"), (n("entry") - n("stop") - n("target")).alias("open"))


@query(
    f"""WITH RECURSIVE {_NB}, dc AS (SELECT instrument, close_ts, close - lag(close) {ORDER}) AS c FROM bars), {_smooth('gn', 'dc', 'greatest(c, 0) + c * 0', 5, '1.0::DOUBLE / 5')}, {_smooth('ls', 'dc', 'greatest(-c, 0) + c * 0', 5, '1.0::DOUBLE / 5')},
    r AS (SELECT nb.*, CASE WHEN ls.v = 0 THEN CASE WHEN gn.v = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + gn.v / ls.v) END AS rsi, {_LEAD} FROM nb LEFT JOIN gn USING (instrument, close_ts) LEFT JOIN ls USING (instrument, close_ts)),
    en AS (SELECT a.instrument, a.i, a.entry_ts, a.entry_price, (SELECT min(b.i) FROM r b WHERE b.instrument = a.instrument AND b.i > a.i AND b.rsi > 55) AS up FROM r a WHERE a.rsi < 35 AND a.entry_ts IS NOT NULL),
    cand AS (SELECT en.instrument, en.i, 1 AS side, x.i AS exit_i, en.entry_ts, en.entry_price, x.close_ts AS exit_ts, x.open AS exit_price, CASE WHEN up <= en.i + 48 THEN 'exit' ELSE 'time-stop' END AS tag FROM en LEFT JOIN nb x ON x.instrument = en.instrument AND x.i = least(coalesce(up, en.i + 48), en.i + 48) + 1),
    {_GREEDY} {_TRIPS}"""
)
def mean_reversion(spark: SparkSession, d: str) -> DataFrame:
    b = adapters.hourly(spark, d)
    return _trips(b, strategies.mean_reversion(b, SPOT, Costs(), rsi=5, entry=35, exit=55, qty=5))


@query(
    f"""WITH RECURSIVE {_NB}, t AS (SELECT instrument, close_ts, {_TR} AS tr FROM bars), {_smooth('e', 't', 'tr', 20, '1.0::DOUBLE / 20')},
    r AS (SELECT nb.*, e.v AS atr, (open_ts // {times.DAY} + 1) * {times.DAY} - close_ts AS lft, count(*) {ORDER} ROWS 19 PRECEDING) AS k, avg(close) {ORDER} ROWS 19 PRECEDING) AS m, stddev_pop(close) {ORDER} ROWS 19 PRECEDING) AS sd, {_LEAD} FROM nb LEFT JOIN e USING (instrument, close_ts)),
    sg AS (SELECT *, CASE WHEN k = 20 AND close > m + sd THEN 1 WHEN k = 20 AND close < m - sd THEN -1 END AS side, greatest(1, CAST(floor(atr * 2 + 0.5) AS BIGINT)) AS away FROM r),
    en AS (SELECT i AS seq, instrument, side, i + 2 AS start, entry_ts, entry_price, entry_price - side * away AS stop, NULL::BIGINT AS target, (SELECT min(b.i) FROM r b WHERE b.instrument = sg.instrument AND b.i > sg.i AND b.lft <= b.close_ts - b.open_ts) AS shut FROM sg
      WHERE side IS NOT NULL AND lft > 1800000000 AND entry_ts IS NOT NULL), {_bracketed('en')},
    cand AS (SELECT ex.instrument, ex.seq AS i, ex.side, CASE WHEN early THEN ex.exit_i ELSE x.i END AS exit_i, ex.entry_ts, ex.entry_price, CASE WHEN early THEN ex.exit_ts ELSE x.close_ts END AS exit_ts,
      CASE WHEN early THEN CASE WHEN side > 0 THEN least(stop, bo) ELSE greatest(stop, bo) END ELSE x.open END AS exit_price, CASE WHEN early THEN 'protective-stop' ELSE 'end-of-session' END AS tag
      FROM (SELECT *, coalesce(exit_i <= coalesce(shut, 4611686018427387904), false) AS early FROM ex) ex LEFT JOIN nb x ON x.instrument = ex.instrument AND x.i = ex.shut + 1), {_GREEDY} {_TRIPS}"""
)
def b3_breakout(spark: SparkSession, d: str) -> DataFrame:
    b = adapters.hourly(spark, d)
    return _trips(b, strategies.session_breakout(b, SPOT, Costs(), deviations=1.0, qty=5))


_EASTER = """easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * ee + 2 * i - h - k) % 7 AS l FROM
  (SELECT y, y % 19 AS a, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h, (y // 100) % 4 AS ee, (y % 100) // 4 AS i, (y % 100) % 4 AS k FROM (SELECT unnest(generate_series(2015, 2045)) AS y)))))"""
_DAYS = f"""{_EASTER}, days AS (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2032-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
  td AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM days JOIN easter ON y = year(date) WHERE dayofweek(date) NOT IN (0, 6) AND strftime(date, '%m-%d') NOT IN ('01-01', '04-21', '05-01', '09-07', '10-12', '11-02', '11-15', '11-20', '12-24', '12-25', '12-31')
    AND date - e NOT IN (-48, -47, -2, 60))"""


@query(f"WITH {_DAYS} SELECT year(date) AS year, month(date) AS month, count(*) AS days FROM td GROUP BY 1, 2")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    s = futures.sessions(spark, futures.B3, "2020-01-01", "2032-12-31")
    return s.groupBy(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month")).agg(F.count("*").alias("days"))


@query(f"WITH {_EASTER} SELECT y AS year, e AS easter FROM easter")
def easter_dates(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(2015, 2046).select(F.col("id").alias("year"), times.easter(F.col("id")).alias("easter"))


def _contracts(rule: str, months: str, root: str, back: int) -> str:
    close = lambda x: f"epoch_us({x}::TIMESTAMP) + 21 * 3600000000"
    return f"""WITH {_DAYS}, g AS (SELECT y, m, {rule} AS base FROM (SELECT unnest(generate_series(2021, 2031)) AS y), (SELECT unnest({months}) AS m)), x AS (SELECT y, m, (SELECT min(n) FROM td WHERE date >= base) AS n FROM g),
    con AS (SELECT '{root}' || substr('FGHJKMNQUVXZ', m, 1) || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS symbol, {close('t.date')} AS expiry, {close('r.date')} AS rolls_at FROM x JOIN td t ON t.n = x.n JOIN td r ON r.n = x.n - {back})"""


_WIN = _contracts("(SELECT arg_min(w, abs(w - make_date(y, m, 15))) FROM (SELECT CAST(unnest(generate_series(make_date(y, m, 11), make_date(y, m, 19), INTERVAL 1 DAY)) AS DATE) AS w) WHERE dayofweek(w) = 3)", "[2, 4, 6, 8, 10, 12]", "WIN", 5)


@query(f"{_WIN} SELECT * FROM con UNION ALL SELECT * FROM ({_contracts('make_date(y, m, 1)', 'generate_series(1, 12)', 'WDO', 3)} SELECT * FROM con)")
def contract_expiries(spark: SparkSession, d: str) -> DataFrame:
    s = futures.sessions(spark, futures.B3, "2020-01-01", "2032-12-31")
    both = [futures.contracts(s, futures.SERIES[r], 2021, 2031) for r in ("WIN", "WDO")]
    return both[0].unionByName(both[1]).select("symbol", "expiry", "rolls_at")


@query(f"{_WIN}, {BARS.split(', bars AS')[0]} SELECT seq, (SELECT arg_min(symbol, rolls_at) FROM con WHERE rolls_at > ts_us) AS front FROM ticks")
def front_contract(spark: SparkSession, d: str) -> DataFrame:
    c = futures.contracts(futures.sessions(spark, futures.B3, "2020-01-01", "2032-12-31"), futures.SERIES["WIN"], 2021, 2031)
    return futures.front(adapters.ticks(spark, d).select("seq", "ts_us"), c, "ts_us").select("seq", "front")


_CLOSES = f"{_DAYS}, {BARS.split(', bars AS')[0]}, ses AS (SELECT date, epoch_us(date::TIMESTAMP) + 12 * 3600000000 AS o, epoch_us(date::TIMESTAMP) + 21 * 3600000000 AS c FROM td WHERE year(date) BETWEEN 2023 AND 2025)"


@query(f"WITH {_CLOSES} SELECT seq, (SELECT min(c) FROM ses WHERE c > ts_us) AS next_close FROM ticks")
def next_close(spark: SparkSession, d: str) -> DataFrame:
    s = futures.sessions(spark, futures.B3, "2023-01-01", "2025-12-31")
    return futures.next_close(adapters.ticks(spark, d).select("seq", "ts_us"), s, "ts_us").select("seq", "next_close")


@query(f"WITH {_CLOSES} SELECT seq, c AS session_close FROM ticks LEFT JOIN ses ON ts_us >= o AND ts_us < c")
def session_interval(spark: SparkSession, d: str) -> DataFrame:
    from barloom.operators.lookups import within

    s = futures.sessions(spark, futures.B3, "2023-01-01", "2025-12-31").withColumn("session_close", F.col("close_ts"))
    t = adapters.ticks(spark, d).select("seq", "ts_us")
    local = times.day_index(F.col("ts_us") - 3 * times.HOUR)
    return within(t, s, F.col("ts_us"), local, ["session_close"]).select("seq", "session_close")


# Contracts from shipments: a line number is a contract with a bar for each day; each rolls at the end of a year.
_SHIP = f"""sb AS (SELECT 'C' || CAST(l_linenumber AS VARCHAR) AS instrument, epoch_us(l_shipdate) AS open_ts, epoch_us(l_shipdate) + {times.DAY} AS close_ts, CAST(min(p) AS BIGINT) AS open, CAST(max(p) AS BIGINT) AS high, CAST(min(p) AS BIGINT) AS low, CAST(sum(p) // count(*) AS BIGINT) AS close,
  CAST(sum(q) AS BIGINT) AS volume FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1, 2, 3),
  co AS (SELECT 'C' || CAST(k AS VARCHAR) AS symbol, k, epoch_us(make_timestamp(1995 + k, 1, 1, 0, 0, 0)) AS rolls_at FROM (SELECT unnest(generate_series(1, 7)) AS k)),
  en AS (SELECT symbol, k, CASE WHEN k < 7 THEN (SELECT max(close_ts) FROM sb WHERE instrument = symbol AND close_ts <= rolls_at) END AS until FROM co),
  se AS (SELECT symbol, k, lag(until) OVER (ORDER BY k) AS after, until FROM en),
  gp AS (SELECT se.*, coalesce((SELECT close FROM sb WHERE instrument = 'C' || CAST(k + 1 AS VARCHAR) AND close_ts = until) - (SELECT close FROM sb WHERE instrument = symbol AND close_ts = until), 0) AS gap, (SELECT close FROM sb WHERE instrument = symbol AND close_ts = until) AS own FROM se),
  ad AS (SELECT *, CAST(coalesce(sum(gap) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS shift FROM gp)"""


def _shipments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = adapters.table(spark, d, "lineitem").select(F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("instrument"), times.micros(F.col("l_shipdate")).alias("open_ts"), adapters.cents("l_extendedprice").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    bars = li.groupBy("instrument", "open_ts").agg(F.min("p").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.expr("sum(p) div count(*)").alias("close"), F.sum("q").alias("volume")).withColumn("close_ts", F.col("open_ts") + times.DAY)
    rolls = spark.range(1, 8).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("symbol"), times.micros(F.make_timestamp(F.col("id") + 1995, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("rolls_at"))
    return bars, rolls.withColumn("expiry", F.col("rolls_at"))


@query(f"WITH {_SHIP} SELECT symbol, until AS ts, CAST(gap AS BIGINT) AS gap FROM gp WHERE until IS NOT NULL")
def roll_points(spark: SparkSession, d: str) -> DataFrame:
    return futures.roll_points(*_shipments(spark, d)).where("until is not null").select("symbol", F.col("until").alias("ts"), "gap")


@query(f"WITH {_SHIP} SELECT instrument, open_ts, close_ts, open + shift AS open, high + shift AS high, low + shift AS low, close + shift AS close, volume FROM sb JOIN ad ON symbol = instrument AND (after IS NULL OR close_ts > after) AND (until IS NULL OR close_ts <= until)")
def continuous_difference(spark: SparkSession, d: str) -> DataFrame:
    bars, c = _shipments(spark, d)
    return futures.continuous(bars, futures.roll_points(bars, c), "difference")


@query(
    f"WITH {_SHIP}, rt AS (SELECT *, exp(coalesce(sum(ln(CASE WHEN own IS NULL OR own = 0 THEN 1 ELSE (own + gap) / own END)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 0)) AS scale FROM gp) "
    "SELECT instrument, close_ts, round(floor(open * scale + 0.5) / 100, 0) AS open, round(floor(close * scale + 0.5) / 100, 0) AS close, volume FROM sb JOIN rt ON symbol = instrument AND (after IS NULL OR close_ts > after) AND (until IS NULL OR close_ts <= until)"
)
def continuous_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Open and close in whole units of a hundred, as the product of ratios is a double."""
    bars, c = _shipments(spark, d)
    out = futures.continuous(bars, futures.roll_points(bars, c), "ratio")
    return out.select("instrument", "close_ts", F.round(F.col("open") / 100, 0).alias("open"), F.round(F.col("close") / 100, 0).alias("close"), "volume")


@query(
    f"""WITH {_SHIP}, vx AS (SELECT a.instrument AS symbol, min(a.close_ts) AS ts FROM sb a JOIN sb b ON a.close_ts = b.close_ts AND b.instrument = 'C' || CAST(CAST(substr(a.instrument, 2) AS BIGINT) + 1 AS VARCHAR) WHERE b.volume > a.volume GROUP BY 1),
    vl AS (SELECT co.symbol, k, coalesce(vx.ts, rolls_at) AS roll, CASE WHEN vx.ts IS NOT NULL THEN 'volume' ELSE 'rule' END AS trigger FROM co LEFT JOIN vx USING (symbol)),
    ve AS (SELECT vl.*, (SELECT max(close_ts) FROM sb WHERE instrument = symbol AND close_ts <= roll) AS e FROM vl WHERE k < 7), vp AS (SELECT *, max(e) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ve)
    SELECT symbol, e AS ts, coalesce((SELECT close FROM sb WHERE instrument = 'C' || CAST(k + 1 AS VARCHAR) AND close_ts = e) - (SELECT close FROM sb WHERE instrument = symbol AND close_ts = e), 0) AS gap, trigger FROM vp WHERE e > coalesce(before, -9000000000000000)"""
)
def volume_roll(spark: SparkSession, d: str) -> DataFrame:
    bars, c = _shipments(spark, d)
    return futures.roll_points(bars, c, "volume").where("until is not null").select("symbol", F.col("until").alias("ts"), "gap", "trigger")


@query(f"WITH {_CLOSES} SELECT seq, (SELECT greatest(o, ts_us) FROM ses WHERE c > ts_us ORDER BY c LIMIT 1) AS next_open FROM ticks")
def next_open(spark: SparkSession, d: str) -> DataFrame:
    s = futures.sessions(spark, futures.B3, "2023-01-01", "2025-12-31")
    return futures.next_open(adapters.ticks(spark, d).select("seq", "ts_us"), s, "ts_us").select("seq", "next_open")


@query(f"WITH {_CLOSES} SELECT seq, EXISTS (SELECT 1 FROM ses WHERE ts_us >= o AND ts_us < c) AS is_open FROM ticks")
def session_is_open(spark: SparkSession, d: str) -> DataFrame:
    s = futures.sessions(spark, futures.B3, "2023-01-01", "2025-12-31")
    return futures.is_open(adapters.ticks(spark, d).select("seq", "ts_us"), s, "ts_us").select("seq", "is_open")


@query(
    f"""WITH {_DAYS}, {_NB}, ses AS (SELECT epoch_us(date::TIMESTAMP) + 21 * 3600000000 AS c FROM td WHERE year(date) BETWEEN 2023 AND 2025),
    so AS (SELECT t.seq, t.instrument, t.price - (seq % 50) * 30 AS level, coalesce(b.i, -1) + 1 AS start, t.ts_us FROM ticks t ASOF LEFT JOIN nb b ON t.instrument = b.instrument AND t.ts_us >= b.close_ts),
    hit AS (SELECT so.seq, min(b.close_ts) AS fill_ts FROM so JOIN nb b ON b.instrument = so.instrument AND b.i >= so.start AND b.low <= so.level GROUP BY 1), nc AS (SELECT seq, (SELECT min(c) FROM ses WHERE c > ts_us) AS ends FROM so)
    SELECT seq, ends, CASE WHEN fill_ts <= ends THEN fill_ts END AS fill_ts, (fill_ts <= ends) IS NOT TRUE AS expired FROM so LEFT JOIN hit USING (seq) JOIN nc USING (seq)"""
)
def session_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Limit orders of every tick to buy, for the session: they end with the close that comes next."""
    o = adapters.ticks(spark, d).select(F.col("seq").alias("order_id"), "instrument", F.col("ts_us").alias("active_from"), F.lit("limit").alias("kind"), F.lit(1).alias("side"), (F.col("price") - (F.col("seq") % 50) * 30).alias("level"))
    found = matching.first_touch(o, adapters.hourly(spark, d))
    ended = futures.next_close(found, futures.sessions(spark, futures.B3, "2023-01-01", "2025-12-31"), "active_from")
    alive = F.coalesce(F.col("fill_ts") <= F.col("next_close"), F.lit(False))
    return ended.select(F.col("order_id").alias("seq"), F.col("next_close").alias("ends"), F.when(alive, F.col("fill_ts")).alias("fill_ts"), (~alive).alias("expired"))
