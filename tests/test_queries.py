"""Every registered query against its oracle, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import check

from threadloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    check(QUERIES[name], ORACLES[name], spark, SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_rows_only(spark, name):
    """Queries without an oracle: all columns are computed, there are rows, and reruns agree."""
    first, again = (sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
