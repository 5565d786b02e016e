"""The queries that SQL can express equal their SQL, and every query of the list is registered."""

import pytest

from __spark_entry__ import oracle_sql, queries
from sluice.llm.sql import SQL
from tests.compare_util import compare
from tests.conftest import SF001


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck001, key):
    ok, msg = compare(queries()[key](spark, SF001), duck001, oracle_sql()[key])
    assert ok, msg


def test_all_are_registered():
    names = list(queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
