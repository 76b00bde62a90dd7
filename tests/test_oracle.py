"""Every registered query against its SQL, at the smallest scale."""

import os
from decimal import Decimal

import duckdb
import pytest

from marram import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def cell(x):
    if isinstance(x, float | Decimal):
        x = round(float(x), 5)
        return str(int(x)) if x == int(x) else str(x)
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())
