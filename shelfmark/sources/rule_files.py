"""Category rules from decision-table XML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One <rule> element, and the order of its output columns.
RULE_SCHEMA = "inputEntry array<struct<text string>>, outputEntry array<struct<text string>>"
OUTPUTS = ("isBegins", "category", "subcategory", "description")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, '"', "")


def _rules(elements: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Rules of parsed elements.

    The levels shift by one: the table's category becomes the type, its subcategory the category, its description the
    sub-category, and the rule itself has no description.  A rule without all four outputs is left out.
    """
    complete = elements.filter(F.size("outputEntry") == len(outputs))

    def output(name: str) -> Column:
        return _unquoted(F.element_at(F.col("outputEntry"), outputs.index(name) + 1)["text"])

    return complete.select(
        F.explode(F.col("inputEntry")["text"]).alias("path"),
        (F.lower(output("isBegins")) == "true").alias("is_begins"),
        output("category").alias("category_type"),
        output("subcategory").alias("category"),
        output("description").alias("sub_category"),
    ).select(
        "category_type", "category", "sub_category", _unquoted(F.col("path")).alias("path"),
        F.coalesce("is_begins", F.lit(False)).alias("is_begins"), F.lit("").alias("description"),
    )


def rules_from_xml(spark: SparkSession, path: str, outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """Rules of the decision tables at ``path``, ready for ``upsert_rules``."""
    elements = spark.read.format("xml").option("rowTag", "rule").schema(RULE_SCHEMA).load(path)
    return _rules(elements, outputs)


def rules_from_xml_text(elements: DataFrame, column: str = "rule", outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """The same from a column that holds one <rule> element per row."""
    parsed = elements.select(F.from_xml(F.col(column), RULE_SCHEMA).alias("r")).select("r.*")
    return _rules(parsed, outputs)
