"""Every query of the library against its twin, and entry()."""

import pytest

import __spark_entry__ as entry_module
from lumenfold.plans import ORACLES, QUERIES
from tests.twins import connection, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    assert (columns, rows) == duck_rows(connection(FOLDER), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert not any(name.startswith("op") for name in QUERIES)
