"""Every query against its SQL text in another engine, on the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from oracles import checks
from runledger import queries
from tests.conftest import CHECKED

QUERIES = queries.queries()
ORACLES = checks.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{CHECKED}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sorted_rows(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, CHECKED)
    columns = sorted(df.columns)
    result = database.execute(ORACLES[name])
    found = {column[0]: str(column[1]) for column in result.description}
    assert sorted(found) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == found
    at = [list(found).index(c) for c in columns]
    expected = sorted_rows(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    actual = sorted_rows(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert len(actual) > 0
    assert actual == expected


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 15
    ranks = [{"P1": 1, "P2": 2, "P3": 3}.get(row.priority, 4) for row in rows]
    assert ranks == sorted(ranks)
