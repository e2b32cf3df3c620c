"""Every registered query against its SQL on the sf0.01 tables, compared by column name and value."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def comparable(rows, order):
    def key(value):
        if value is None:
            return (0, "")
        if isinstance(value, float) and not math.isnan(value):
            return (1, repr(value + 0.0))
        return (1, str(value))

    return sorted(tuple(key(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    rows = result.collect()
    assert rows
    if name not in contract.oracle_sql():
        return
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    assert sorted(names) == sorted(result.columns)
    by_name = lambda columns: sorted(range(len(columns)), key=lambda i: columns[i])
    assert comparable(rows, by_name(result.columns)) == comparable(expected, by_name(names))


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
