"""Every registered query equals its DuckDB oracle (sf0.001 here; the driver uses sf0.01)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sluice.sql_catalog import SQL
from tests.compare_util import compare
from tests.conftest import SF001

KEYS = sorted(SQL)


def test_every_query_has_oracle():
    assert [k for k in KEYS if k not in oracle_sql() or k not in queries()] == []


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck001, key):
    ok, msg = compare(queries()[key](spark, SF001), duck001, oracle_sql()[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "decision" in df.columns
