"""Every catalogue query against the SQL registered for it, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as catalogue

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else value + 0.0
        return value

    return sorted(tuple(repr(plain(row[i])) for i in order) for row in rows)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, sf_dir, database, name):
    result = catalogue.queries()[name](spark, sf_dir)
    rows = comparable(result.collect(), result.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = database.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(result.columns)
    assert rows == comparable(answer.fetchall(), columns)


def test_entry(spark):
    assert catalogue.entry(spark).count() == 2


def test_every_answer_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
