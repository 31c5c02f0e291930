"""Catalogue tables from Parquet or from a live database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.schema import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root`` with its declared column types; filters and columns reach the Parquet scan."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def hex_ranges(column: str, parts: int = 256) -> list[str]:
    """Predicates that cut an upper-case hex key into ranges of equal width, open at both ends."""
    digits = max(2, len(f"{max(1, parts) - 1:X}"))
    whole = 16**digits
    cuts = sorted({f"{whole * i // parts:0{digits}X}" for i in range(1, parts)})
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= '{low}' AND {column} < '{high}'" for low, high in zip(cuts, cuts[1:])]
    return [f"{column} < '{cuts[0]}'", *inner, f"{column} >= '{cuts[-1]}'"]


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = "id", parts: int = 256, **properties: str
) -> DataFrame:
    """Table of a live catalogue database, read in parallel by ranges of its hash key.

    Without a hash key (``key=None``) one task reads it, which fits the device, rule and job tables.
    """
    if key is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, predicates=hex_ranges(key, parts), properties=properties)
