"""Every query of the training-data operators that has SQL, against it, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pagemill.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query(spark, database, name):
    function, sql = QUERIES[name]
    frame = function(spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    answer = database.sql(sql)
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[p]) for p in places) for row in answer.fetchall())
