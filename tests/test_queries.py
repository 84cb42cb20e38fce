"""Every query with SQL against DuckDB on the small tables; those without must run."""
import math
from pathlib import Path

import pytest

from folioforge.plans import registry
from tests.conftest import DATA

SMALL = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return float(v)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, name):
    df = Q[name](spark, str(SMALL))
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name not in SQL:
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert mine == sorted(repr(tuple(norm(x[names.index(c)]) for c in cols)) for x in r.fetchall())


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(Q) and Path(__file__).exists()
