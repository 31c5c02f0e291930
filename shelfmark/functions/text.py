"""Search patterns and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_pattern(text: str) -> str:
    """LIKE pattern of a search text: lower case, each space matches anything, a backslash stands for itself."""
    return "%" + text.replace("\\", "\\\\").replace(" ", "%").lower() + "%"


def kilobytes(size: Column) -> Column:
    """Whole KB with thousands separators."""
    return F.format_number(F.floor(size / 1024), 0)


def mebibytes(size: Column) -> Column:
    """Size in MiB, rounded half up."""
    return F.round(size / F.lit(1048576)).cast("bigint")


def timestamp_text(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")
