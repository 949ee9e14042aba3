"""Every core query with SQL against DuckDB, and the others for columns and rows."""

import pytest

from tallyforge.plans import catalog
from tests.oracle import DATA, check

REGISTRIES = {n: r for r in catalog.registries() for n in r.queries}


@pytest.mark.parametrize("name", [n for n, r in REGISTRIES.items() if n in r.sql])
def test_same_as_sql(spark, name):
    check(spark, REGISTRIES[name], name)


@pytest.mark.parametrize("name", [n for n, r in REGISTRIES.items() if n not in r.sql])
def test_runs(spark, name):
    assert REGISTRIES[name].queries[name](spark, DATA).count() > 0
