"""Every query with an oracle against DuckDB on the smallest tables; every other query must run."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from check_oracle import TABLES, compare
from tidemark.plans import ORACLES, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RUN = [n for n in QUERIES if n in ORACLES]
REST = [n for n in QUERIES if n not in ORACLES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", RUN)
def test_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLES[name]).df()) == "ok"


@pytest.mark.parametrize("name", REST)
def test_query_without_oracle_runs(spark, name):
    """Rows come out (the smallest tables have too few hours for the long windows)."""
    got = QUERIES[name](spark, MIDDLE).toPandas()
    assert len(got) and not got.columns.duplicated().any()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
