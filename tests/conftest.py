"""A session for all tests, the smallest test data, and DuckDB over it."""

from __future__ import annotations

import datetime
import decimal
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    found = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return found


def plain(value: object) -> object:
    """Values that two engines give for the same thing, made equal."""
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return round(value, 6) if value == value else None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


def in_order(rows: list, columns: list[str]) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture()
def same(spark, duck):
    """Whether a query and its SQL agree."""

    def check(query, sql) -> None:
        found = query(spark, DATA)
        wanted = duck.sql(sql)
        assert sorted(found.columns) == sorted(wanted.columns)
        assert in_order(found.collect(), found.columns) == in_order(wanted.fetchall(), wanted.columns)

    return check
