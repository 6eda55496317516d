from __future__ import annotations

from pathlib import Path

import duckdb
import pytest


@pytest.fixture(scope="session")
def database():
    connection = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use too."""
    plain = "the quick brown fox jumps over the lazy dog and then runs on to the river "
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 1),
        (3, " \t\n ", "en", None, 2),
        (4, "one two", "en", "b", 3),
        (5, plain * 4000, "en", "b", 4),
        (6, plain + "x" * 5000, "de", "b", 5),
        (7, "Grüße ▁ 東京 😀 a  b\n\nc\n\nc", "de", "c", 6),
        (8, plain, "en", "c", 7),
        (8, plain, "en", "c", 7),
        (9, plain, "en", "c", 8),
        (None, plain, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashing = ["id", "host", "class", "key", "info", "score", "w", "size", "label", "bin", "spans", "pieces", "n", "slice", "kept", "train"]
    return docs.selectExpr("*", *(f"n_chars AS {name}" for name in clashing)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
