"""Every query of the time-series engine that SQL can express equals its twin."""

from __future__ import annotations

import pytest

from oracle import compare, connection
from tidemark.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(name, spark, sf_dir, duck):
    compare(QUERIES[name](spark, sf_dir), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
