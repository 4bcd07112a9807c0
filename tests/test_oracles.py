"""Every query that has SQL gives the same rows as DuckDB."""

from __future__ import annotations

import pytest

from compare import rows_of
from inkwell.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, sf, oracle):
    df = catalog.QUERIES[name](spark, sf)
    columns, rows = oracle(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(list(columns), rows)


def test_the_only_query_without_sql_is_compared_elsewhere():
    """tests/test_ledger.py replays it by brute force."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"ledger_stateful"}


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
