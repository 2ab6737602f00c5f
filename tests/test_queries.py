"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from catalog.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def content(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, checker, name):
    df = QUERIES[name](spark, FOLDER)
    expected = checker.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert content(df.columns, df.collect()) == content(expected.columns, expected.fetchall())
