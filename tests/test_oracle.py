"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest
from helpers import plain

import __spark_entry__ as entry_points
from forumlens.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "conversations embeddings documents benchmark pages".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(registry.all_queries()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query_equals_sql(spark, database, name):
    frame = entry_points.queries()[name](spark, SF)
    answer = database.execute(entry_points.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in answer.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema} == types
    names = sorted(frame.columns)
    places = [[c[0] for c in answer.description].index(n) for n in names]
    expected = sorted((tuple(plain(row[i]) for i in places) for row in answer.fetchall()), key=repr)
    found = sorted((tuple(plain(row[n]) for n in names) for row in frame.collect()), key=repr)
    assert found == expected


def test_entry_runs(spark):
    found = entry_points.entry(spark)
    assert found.columns == entry_points.entry(spark).columns
    assert found.count() > 0
