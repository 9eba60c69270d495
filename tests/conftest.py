from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT}/tests:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from barloom.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value as both engines have it."""
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)


def same_rows(spark_df, con, sql: str) -> None:
    from collections import Counter

    names = sorted(spark_df.columns)
    rows = spark_df.select(*(f"`{n}`" for n in names)).collect()
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    got = Counter(tuple(plain(v) for v in r) for r in rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
