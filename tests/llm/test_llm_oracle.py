"""Corpus queries that SQL can state, against DuckDB on the given data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import rows

from shelfmark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = connection.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert rows(found, *columns) == sorted((tuple(r) for r in cursor.fetchall()), key=key)
