"""Sort orders that put NULL where PostgreSQL puts it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascending(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def descending(name: str) -> Column:
    return F.col(name).desc_nulls_first()
