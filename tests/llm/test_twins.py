"""The numbered queries that SQL can express, against their DuckDB twins."""

import pytest

from lumenfold.llm.queries import oracle_sql, queries
from tests.twins import connection, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, name):
    folder = "/root/testdata/sf0.001" if name == "op6_suffix_dedup" else "/root/testdata/sf0.01"
    columns, rows = spark_rows(queries()[name](spark, folder))
    assert (columns, rows) == duck_rows(connection(folder), oracle_sql()[name])
