"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from casewright.plans import load_queries
from casewright.plans.registry import ORACLES as SQL
from casewright.plans.registry import QUERIES
from tests.conftest import SF
from tools.check_oracle import TABLES, rows_of

load_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
