"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_compare import TABLES, compare

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "OK", r


def test_every_query_runs(spark):
    rows_only = sorted(set(E.queries()) - set(ORACLE))
    for name in rows_only:
        assert E.queries()[name](spark, SF_SMALL).count() >= 0, name


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns[:3] == ["domain", "arm", "n"]
