"""Search by file name through an index of three-letter pieces.

``postings`` lists under each piece the distinct names that contain it, sorted by piece, so a search reads the row groups
of one piece; ``pieces`` counts the names of each.  A text is looked up by the rarest of its pieces, and the whole
pattern decides on what is listed there.  A text without three letters in a row has no piece; then all distinct names
are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import contains_pattern
from shelfmark.operators.changes import write_snapshot
from shelfmark.session import remove_dir
from shelfmark.settings import SEARCH_ROWS

PIECE = 3
_NAMES_DDL = "f_name string, f_name_lc string"
_POSTINGS_DDL = f"piece string, {_NAMES_DDL}"
_COUNTS_DDL = "piece string, names bigint"


def _pieces(name: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(name) - PIECE + 1)
    found = F.array_distinct(F.transform(starts, lambda at: F.substring(name, at, F.lit(PIECE))))
    return F.when(F.length(name) >= PIECE, found)


def pieces_of_text(text: str) -> list[str]:
    """The pieces that a name must contain to match the search text: those of its runs without a wildcard."""
    runs = re.split(r"[ %_]+", text.lower())
    return sorted({run[at : at + PIECE] for run in runs for at in range(len(run) - PIECE + 1)})


def write_name_index(cards: DataFrame, root: str) -> None:
    """Index the distinct names of the file cards below ``root``, replacing what lies there."""
    spark = cards.sparkSession
    remove_dir(spark, root)
    names = cards.select("f_name", F.lower("f_name_lc").alias("f_name_lc")).distinct()
    write_snapshot(names, f"{root}/names", ["f_name_lc", "f_name"])
    names = spark.read.schema(_NAMES_DDL).parquet(f"{root}/names")
    write_snapshot(names.select(F.explode(_pieces(F.col("f_name_lc"))).alias("piece"), *names.columns), f"{root}/postings", ["piece", "f_name"])
    postings = spark.read.schema(_POSTINGS_DDL).parquet(f"{root}/postings")
    write_snapshot(postings.groupBy("piece").agg(F.count(F.lit(1)).alias("names")), f"{root}/pieces", ["piece"])


def _candidates(spark: SparkSession, root: str, text: str) -> DataFrame:
    pieces = pieces_of_text(text)
    if not pieces:
        return spark.read.schema(_NAMES_DDL).parquet(f"{root}/names")
    counts = spark.read.schema(_COUNTS_DDL).parquet(f"{root}/pieces")
    # At most as many rows as the text has letters.
    known = {row.piece: row.names for row in counts.filter(F.col("piece").isin(pieces)).collect()}
    rarest = min(pieces, key=lambda piece: (known.get(piece, 0), piece))
    return spark.read.schema(_POSTINGS_DDL).parquet(f"{root}/postings").filter(F.col("piece") == rarest)


def search_index(spark: SparkSession, root: str, text: str, limit: int = SEARCH_ROWS, most: int = SEARCH_ROWS) -> DataFrame:
    """The rows of ``search.search_names``, found through the index."""
    found = _candidates(spark, root, text).filter(F.col("f_name_lc").like(contains_pattern(text)))
    return found.select("f_name").distinct().orderBy("f_name").limit(min(limit, most))
