"""Each registered query of the core against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from heronry.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def canon(rows):
    f = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted(repr(tuple(map(f, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = canon(map(tuple, df.select(*columns).collect()))
    if name not in ORACLE_SQL:
        assert rows
        return
    r = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert canon(tuple(x[i] for i in order) for x in r.fetchall()) == rows


def test_entry_counts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES)
