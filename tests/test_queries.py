"""Every registered query against its SQL on the test tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from txnflow import checks

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def plain(rows):
    def value(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(x)

    return sorted(tuple(value(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(checks.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = entry.queries()[name](spark, sf_dir)
    columns = sorted(result.columns)
    found = [tuple(r[c] for c in columns) for r in result.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert found, "no rows"
    assert plain(found) == plain(expected)


def test_every_query_has_sql():
    assert set(checks.QUERIES) == set(checks.ORACLES)


def test_entry_is_the_import(spark):
    assert {r["route"] for r in entry.entry(spark).select("route").distinct().collect()} == {"fraud", "non_fraud"}


def test_names_are_plain():
    assert set(checks.ORACLES) <= set(checks.QUERIES)
    assert not [n for n in checks.QUERIES if "pipeline" in n or n.startswith("op")]
