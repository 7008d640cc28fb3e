"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from skarn.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def norm(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else os.path.join(p, '*.parquet')}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, str(DATA))
    wanted = duck.sql(plans.ORACLE_SQL[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(wanted.columns, wanted.fetchall())


def test_entry_without_a_session():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLE_SQL) <= set(entry.oracle_sql())
