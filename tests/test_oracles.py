"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import glob
import math
import os

import duckdb
import pytest

from tessellar.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if hasattr(x, "as_integer_ratio"):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(round(float(x), 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in registry.ORACLES:
        found = db.execute(registry.ORACLES[name])
        given = [c[0] for c in found.description]
        assert sorted(given) == names
        assert sorted(tuple(plain(r[given.index(c)]) for c in names) for r in found.fetchall()) == rows
    else:
        assert rows or name in ("edit_distance",)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
