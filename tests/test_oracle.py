"""Every query against DuckDB on the small data set."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import rows

SF = "/root/testdata/sf0.001"
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    "double": "DOUBLE",
}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_its_sql(spark, oracle, name):
    found = contract.queries()[name](spark, SF)
    cursor = oracle.execute(contract.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in cursor.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema.fields} == types
    columns = list(types)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert rows(found, *[f"`{c}`" for c in columns]) == sorted((tuple(r) for r in cursor.fetchall()), key=key)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_import_needs_no_session():
    root = Path(contract.__file__).parent
    code = "import __spark_entry__ as c; assert set(c.oracle_sql()) <= set(c.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
