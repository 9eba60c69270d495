from __future__ import annotations

import pytest
from conftest import same_rows

from barloom import plans
from barloom.plans.registry import QUERIES, SQL

plans.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_has_the_rows_of_its_sql(name, spark, data, duck):
    same_rows(QUERIES[name](spark, data), duck, SQL[name])


def test_short_positions_have_the_rows_of_the_sql_on_a_larger_table(spark):
    """The smallest table has hardly a short that its stop ends within a bar."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    same_rows(QUERIES["b3_breakout"](spark, "/root/testdata/sf0.01"), con, SQL["b3_breakout"])


@pytest.mark.parametrize("name", ["b3_breakout", "breakout_bracket", "mean_reversion", "bars_1h", "stream_bars"])
def test_ticks_without_price_or_time_have_the_rows_of_the_sql(spark, tmp_path, name):
    """Bars that begin or end with a tick without a price, bars of such ticks alone, and ticks without a time or an instrument."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i % 41 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(i * 700 + i * 37 % 600) END AS ts, 1::BIGINT AS user_id, CASE i % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN CASE WHEN i % 17 <> 0 THEN 'c' END END AS event_type,
      CASE WHEN i * 7919 % 4001 % 5 > 1 THEN (20000 + 5000 * sin(i / 50) + i * 7919 % 4001)::BIGINT / 100 END AS value, NULL::VARCHAR AS props FROM range(3000) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)), con, SQL[name])
    assert con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_and_batch_have_the_same_fills(spark, data):
    rows = QUERIES["stream_kernel_equals_batch"](spark, data).collect()
    assert rows and all(r["equal"] for r in rows)


def test_ledger_identity_holds_in_runs(spark, data):
    from pyspark.sql import functions as F

    from barloom.operators import runs
    from barloom.operators.instruments import Costs
    from barloom.plans.simulation import SPOT
    from barloom.sources import adapters

    seen = 0
    for strategy, params in (("sma-crossover", {"fast": 4, "slow": 12, "flatten": True}), ("breakout", {"lookback": 12, "volume": 1.0}), ("mean-reversion", {"rsi": 5, "entry": 40}), ("session-breakout", {"deviations": 1.0})):
        events = runs.run(adapters.hourly(spark, data), strategy, SPOT, Costs(("bps", 15), ("percent", "0.1", "0.1")), F.col("instrument"), **params).persist()
        flat = {r["run_id"] for r in events.where("kind = 'equity'").groupBy("run_id").agg(F.max_by("qty", "ts").alias("q")).where("q = 0").collect()}
        ends = [r for r in events.where("kind = 'final'").collect() if r["run_id"] in flat]
        seen += len(ends)
        assert all(r["amount"] == runs.CASH + r["slippage"] - r["commission"] for r in ends)
        trades = {r["run_id"]: r["gross"] for r in runs.trades(events).groupBy("run_id").agg(F.sum("gross").alias("gross")).collect()}
        assert all(trades.get(r["run_id"], 0) == r["slippage"] for r in ends)
        assert runs.trades(events).where("exit_ts < entry_ts or qty <= 0").count() == 0
        lines = runs.canonical(events).orderBy("run_id", "kind", "ts", "seq").collect()
        assert lines == runs.canonical(events.repartition(3)).orderBy("run_id", "kind", "ts", "seq").collect()
        events.unpersist()
    assert seen > 0


def test_a_bracket_with_one_leg_closes_at_that_leg(spark):
    from barloom.operators import matching

    bars = spark.createDataFrame([("A", 0, 10, 100, 105, 95, 101, 1), ("A", 10, 20, 100, 130, 70, 101, 1)], "instrument string, open_ts long, close_ts long, open long, high long, low long, close long, volume long").selectExpr("*", "open_ts div 10 as i")
    entries = spark.createDataFrame([("A", 0, 1, 80, None), ("A", 0, -1, 120, None), ("A", 0, 1, None, 110), ("A", 0, -1, None, 90), ("A", 0, 1, None, None)], "instrument string, start long, side int, stop long, target long")
    tables = matching.levels(bars)
    for policy in matching.POLICIES:
        found = {(r["side"], r["stop"], r["target"]): (r["exit_i"], r["leg"], r["exit_price"], r["ambiguous"]) for r in matching.brackets(entries, bars, tables, policy).collect()}
        assert found == {
            (1, 80, None): (1, "stop", 80, False), (-1, 120, None): (1, "stop", 120, False), (1, None, 110): (1, "target", 110, False), (-1, None, 90): (1, "target", 90, False), (1, None, None): (None, None, None, False),
        }


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_long_lines_of_time_are_cut_into_blocks(spark, monkeypatch, forward, strict):
    """Three keys of different lengths, one of a single time, null keys and times, bars that are few, many, or at one end only."""
    import random
    from bisect import bisect_left, bisect_right
    from collections import Counter

    from pyspark.sql import functions as F

    from barloom.operators import lookups

    pick = random.Random(7)
    wanted = [("A", pick.randrange(10_000)) for _ in range(4000)] + [("B", pick.randrange(300)) for _ in range(700)] + [("C", 5)] * 300 + [("D", t) for t in range(20)] + [(None, t) for t in range(150)]
    wanted += [("A", None)] * 5
    points = {"A": [*range(4000, 4040), 9000], "B": [*range(0, 300, 2)], "C": [5, 6], "E": [1], None: [70]}
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(wanted)], "id int, key string, at long").repartition(3)
    right = spark.createDataFrame([(k, t, t * 3) for k, ts in points.items() for t in ts] + [("B", None, -1)], "key string, ts long, v long")
    run = lambda: lookups.as_of(left, right, "key", "at", "ts", ["v"], forward=forward, strict=strict)
    rows = lambda df: Counter((r["id"], r["key"], r["at"], r["v"]) for r in df.collect())
    whole = rows(run())
    monkeypatch.setattr(lookups, "MOST_LINE", 100, raising=False)
    cut = run()
    assert rows(cut) == whole and len(whole) == len(wanted)

    def found(key, at):
        ts = points.get(key, [])
        n = (bisect_right if strict else bisect_left)(ts, at) if forward else (bisect_left if strict else bisect_right)(ts, at) - 1
        return ts[n] * 3 if 0 <= n < len(ts) else -1 if key == "B" and not forward else None

    assert all(v == found(k, t) for _, k, t, v in whole if t is not None)
    # Values are counted too, as else no line would be sorted.
    most = cut.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.count("v").alias("met")).agg(F.max("n"), F.sum("met")).first()[0]
    assert most < 800
