"""Every registered query runs, and equals its SQL where it has one."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def ordered(rows, columns):
    picked = [tuple(plain(dict(zip(columns, row))[c]) for c in sorted(columns)) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = entry_point.queries()[name](spark, sf_dir)
    rows = [tuple(row) for row in df.collect()]
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = oracle.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(rows, df.columns) == ordered(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["band", "band_order", "n", "frauds", "fraud_pct"]
