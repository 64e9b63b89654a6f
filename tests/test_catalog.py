"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "lineitem"]

QUERIES = entry_point.QUERIES  # the library's own; the optional parts have their own tests
ORACLES = entry_point.ORACLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def normal(rows):
    return sorted((tuple(row) for row in rows), key=lambda row: [(cell is None, str(cell)) for cell in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = normal(found.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    wanted = duck.execute(ORACLES[name])
    names = [column[0] for column in wanted.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    assert rows == normal([row[i] for i in order] for row in wanted.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
