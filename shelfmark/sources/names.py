"""Lists of file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def names_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One name per line, carriage returns and line feeds removed."""
    return lines.select(F.regexp_replace(F.col(column), "[\r\n]", "").alias("f_name"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    return names_of_lines(spark.read.text(path))
