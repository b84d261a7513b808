"""Every registered query against its SQL on DuckDB."""

import decimal
import math

import duckdb
import pytest

from tests.conftest import SF
from tidewater.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


def rows(columns, names, found):
    at = [names.index(c) for c in columns]
    return sorted(((tuple(plain(r[i]) for i in at)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(columns, df.columns, df.collect())
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == rows(columns, names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_repeats(spark, name):
    a, b = (sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str) for _ in range(2))
    assert a and a == b
