"""Queries with SQL agree with it; all others run over their whole table."""

from __future__ import annotations

import pytest

from lexispark.llm import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, spark, sf_dir):
    oracle.assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], oracle.tables(sf_dir))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_every_document_has_a_row(name, spark, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
