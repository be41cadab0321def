"""Every registered query against its SQL check on the smallest data folder."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    result = check.compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert result.startswith(("ok", "rows only")) and "TYPES" not in result, result


def test_entry(spark):
    assert entry(spark).count() > 0
