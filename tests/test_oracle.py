"""Every registered query of the library's own operators against its DuckDB twin."""

import os

import duckdb
import pytest

from parley.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows_of(table, columns):
    tidy = lambda v: round(v, 9) if isinstance(v, float) and v == v else v
    return sorted(repr([tidy(row[c]) for c in columns]) for row in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    found = registry.queries()[name](spark, SF_DIR).toArrow()
    columns = sorted(found.column_names)
    if name not in registry.oracle_sql():
        assert found.num_rows > 0
        return
    wanted = oracle.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(wanted.column_names) == columns
    assert rows_of(found, columns) == rows_of(wanted, columns)
