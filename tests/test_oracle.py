"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) is None
    else:
        assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    assert entry(spark).count() == 3


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
