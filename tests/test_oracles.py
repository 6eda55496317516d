"""All queries against DuckDB, and the known row counts of the two lanes."""

from __future__ import annotations

import importlib
import math
from pathlib import Path

import duckdb
import pytest

from tallybrook.plans.queries import registered

entry = importlib.import_module("__spark_entry__")
ORACLES = importlib.import_module("oracle_queries").ORACLES


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return str(value)[:10] if hasattr(value, "year") else value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    return sorted((tuple(_plain(row[index]) for index in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, database, name):
    result = registered()[name](spark, sf_dir)
    expected = database.execute(ORACLES[name])
    names = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(names)
    assert _sorted(result.collect(), result.columns) == _sorted(expected.fetchall(), names)


def test_every_query_has_sql():
    assert set(registered()) == set(ORACLES)
    assert set(registered()) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 30


@pytest.mark.parametrize(
    "name, rows",
    [
        ("bronze_valid", 913),
        ("bronze_quarantine", 69 + 18),
        ("silver_dedup", 4599),
        ("gold_seller_metrics", 181),
        ("gold_city_metrics", 119),
        ("gold_platform_metrics", 30),
        ("gold_seller_metrics_l", 911),
        ("gold_city_metrics_l", 920),
        ("gold_platform_metrics_l", 777),
    ],
)
def test_known_row_counts(spark, sf_dir, name, rows):
    assert registered()[name](spark, sf_dir).count() == rows
