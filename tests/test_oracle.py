"""Every registered query against its DuckDB oracle (small scale factor)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck
from tests.conftest import SF_SMALL
from watchpost.plans import catalog

QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalog.QUERIES}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert sorted(catalog.QUERIES) == sorted(catalog.ORACLE)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["org", "dep_total"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    result = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert result[1] in ("OK", "ROWS"), result
