"""Path rules and the categories they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.groups import numbered, one_per_key
from shelfmark.operators.prefixes import with_prefix

_TRIPLE = ["category_type", "category", "sub_category"]
_CONTENT = ["sha256", "f_name"]


def rule_of_folder(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """(f_parent, id): the lowest rule with a path the folder's text starts with.

    The path is a plain text prefix, not a path boundary, and a rule's ``is_begins`` makes no difference.
    """
    paths = one_per_key(rules.select("id", F.explode("f_path").alias("path")), ["path"], F.min("id").alias("id"))
    matched = with_prefix(folders.select("f_parent").distinct(), "f_parent", paths, "path")
    return one_per_key(matched, ["f_parent"], F.min("id").alias("id"))


def apply_rules(cards: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """The category table with every hashed, uncategorised content and name added that a rule covers.

    Where several rules do, the lowest id wins.  Copies are reduced to distinct (content, name, folder) before any
    join, so a content with very many copies in a folder is one row.
    """
    files = cards.filter("sha256 IS NOT NULL").select(*_CONTENT, "f_parent").distinct()
    ruled = files.join(rule_of_folder(cards, rules), "f_parent")
    added = ruled.groupBy(*_CONTENT).agg(F.min("id").alias("id")).join(categories, _CONTENT, "left_anti")
    return categories.unionByName(added.select(*categories.columns))


def upsert_rules(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """The rule table after requests (category_type, category, sub_category, path, is_begins, description).

    An unknown triple becomes a rule with the requested paths; a known one gains the paths it lacks and keeps its flag
    and description.  Requests without type, category or sub-category are rejected.  Several requests for one new
    triple count as one: a rule "begins" if any of them says so and takes the first description by text.
    """
    complete = requests.filter(" AND ".join(f"{c} IS NOT NULL AND {c} != ''" for c in _TRIPLE))
    asked = complete.groupBy(*_TRIPLE).agg(
        F.array_sort(F.collect_set("path")).alias("paths"),
        F.max("is_begins").alias("asked_begins"),
        F.min(F.when(F.col("description") != "", F.col("description"))).alias("asked_description"),
    )
    known = rules.join(asked.select(*_TRIPLE, "paths"), _TRIPLE, "left").withColumn(
        "f_path", F.when(F.col("paths").isNull(), F.col("f_path")).otherwise(F.array_union("f_path", "paths"))
    )
    start = rules.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = numbered(asked.join(rules.select(*_TRIPLE), _TRIPLE, "left_anti"), _TRIPLE, start, rules.schema["id"].dataType).select(
        "id", *_TRIPLE, F.col("paths").alias("f_path"), F.col("asked_begins").alias("is_begins"),
        F.col("asked_description").alias("description"),
    )
    return known.select(*rules.columns).unionByName(new.select(*rules.columns))
