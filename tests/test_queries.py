"""Every registered query of the library runs; those with SQL agree with it."""

from __future__ import annotations

import pytest

from lexispark.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.tables(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        oracle.assert_same(df, registry.ORACLES[name], con)
    else:
        assert df.columns and df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["entry_ord", "score", "facet"]
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
