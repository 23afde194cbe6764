"""Every registered query against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = ordered(tuple(plain(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = ordered(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["row_label", "col_label", "n", "row_total", "col_total"]
