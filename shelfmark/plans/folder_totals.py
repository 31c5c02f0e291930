"""Folder sums for all depths in one table, kept up to date by what a scan changes.

Each file counts once for every part of its folder's path, so a row says, for one device, depth and folder name, how
many files and bytes lie there, by category type.  Sums of changed files are added and subtracted, so a table of totals
follows the catalogue without a new pass over it, and every depth of the folder reports is read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.packing import slim
from shelfmark.functions.text import mebibytes

_CONTENT = ["sha256", "f_name"]
# sized: files with bytes, category by content and name; content: category by content alone; any: all files.
SIZED, CONTENT, ANY = "sized", "content", "any"
_PLACE = ["device_uid", "depth", "before", "folder", "ends", "inner"]
_KEY = [*_PLACE, "kind", "category_type", "uncategorised"]


def _per_folder(cards: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """(device_uid, f_parent, kind, category_type, uncategorised, files, size).

    A folder holds a name once, so counting its copies first would shuffle all rows once more; the joins meet the rows
    themselves, and the planner splits a content that many of them share.
    """
    files = slim(cards.select("device_uid", "f_parent", *_CONTENT, "f_size")).withColumn("n", F.lit(1).cast("bigint"))
    types = slim(categories).join(rules.select("id", "category_type"), "id", "left").select(*_CONTENT, "category_type", F.lit(True).alias("found"))

    def summed(rows: DataFrame, kind: str, n: str, open_: Column, size: Column) -> DataFrame:
        named = rows.withColumns({"kind": F.lit(kind), "uncategorised": open_})
        return named.groupBy("device_uid", "f_parent", "kind", "category_type", "uncategorised").agg(
            F.sum(n).alias("files"), F.sum(size).alias("size")
        )

    none = F.lit(None).cast("string")
    by_name = summed(
        files.filter("f_size > 0").join(types, _CONTENT, "left"), SIZED, "n", F.col("category_type").isNull(), F.col("f_size")
    )
    shown = ~F.col("f_parent").endswith("_files") & ~F.col("f_parent").endswith("_files/")
    contents = files.filter(shown).select("device_uid", "f_parent", "sha256", "n")
    per_type = types.groupBy("sha256", "category_type").agg(F.count(F.lit(1)).alias("names"))
    matched = contents.join(per_type, "sha256", "left").withColumn("all", F.col("n") * F.coalesce("names", F.lit(1)))
    by_content = summed(matched, CONTENT, "all", F.col("names").isNull(), F.lit(0).cast("bigint"))
    every = summed(files.withColumn("category_type", none), ANY, "n", F.lit(False), F.lit(0).cast("bigint"))
    return by_name.unionByName(by_content).unionByName(every)


def folder_totals(cards: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Sums per device and part of a folder's path.

    ``depth`` counts the parts from 1, ``folder`` is the part and ``before`` the one above it.  ``ends`` marks the last part,
    empty behind a final "/", and ``inner`` parts that are not just that.  ``kind`` says which files count and how their
    category is found, ``uncategorised`` that they have none.
    """
    parts, trimmed = F.split("f_parent", "/"), F.rtrim(F.col("f_parent"), F.lit("/"))
    own = F.when((trimmed != "") | (F.col("f_parent") == ""), F.size(F.split(trimmed, "/"))).otherwise(0)
    part = F.posexplode(parts).alias("at", "folder")
    rows = _per_folder(cards, categories, rules).select("*", parts.alias("parts"), own.alias("own"), part)
    placed = rows.select(
        "device_uid", (F.col("at") + 1).alias("depth"), F.when(F.col("at") > 0, F.get("parts", F.col("at") - 1)).alias("before"), "folder",
        (F.col("at") + 1 == F.size("parts")).alias("ends"), (F.col("at") < F.col("own")).alias("inner"), "kind", "category_type",
        "uncategorised", "files", "size",
    )
    return placed.groupBy(*_KEY).agg(F.sum("files").alias("files"), F.sum("size").alias("size"))


def merge_totals(totals: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Totals after files were added and removed, each given by its own totals; sums that reach zero go."""
    minus = removed.withColumns({"files": -F.col("files"), "size": -F.col("size")})
    both = totals.unionByName(added).unionByName(minus)
    return both.groupBy(*_KEY).agg(F.sum("files").alias("files"), F.sum("size").alias("size")).filter("files <> 0")


def _summary(rows: DataFrame, *sums: Column) -> DataFrame:
    types = F.array_sort(F.collect_set("category_type"))
    return rows.groupBy("name").agg(*sums, F.when(F.size(types) > 0, types).alias("category_types")).withColumnRenamed("name", "folder").orderBy("folder")


def storage_from_totals(totals: DataFrame, device: str, depth: int = 1) -> DataFrame:
    """The rows of ``folders.storage_by_folder``; a path that ends before the depth has an empty name there."""
    at = F.col("depth") == depth
    mine = totals.filter((F.col("device_uid") == device) & (F.col("kind") == SIZED) & (at | (F.col("ends") & (F.col("depth") < depth))))
    return _summary(
        mine.withColumn("name", F.when(at, F.col("folder")).otherwise("")), mebibytes(F.sum("size")).alias("size_mib"),
        F.sum("files").alias("files"), F.sum(F.when(F.col("uncategorised"), F.col("files")).otherwise(0)).alias("uncategorised"),
    )


def explore_from_totals(totals: DataFrame, device: str, value: str, depth: int) -> DataFrame:
    """The rows of ``folders.explore_folder``."""
    if depth < 2:
        raise ValueError("depth has to be at least 2: there is no path segment 0")
    at = F.col("depth") == depth
    short = F.col("ends") & (F.col("depth") == depth - 1) & (F.col("folder") == value)
    shorter = F.col("ends") & (F.col("depth") < depth - 1) & F.lit(value == "")
    below = (at & (F.col("before") == value)) | short | shorter
    mine = totals.filter((F.col("device_uid") == device) & (F.col("kind") == CONTENT) & below)
    return _summary(
        mine.withColumn("name", F.when(at, F.col("folder")).otherwise("")), F.sum("files").alias("files"),
        F.sum(F.when(F.col("uncategorised"), F.col("files")).otherwise(0)).alias("uncategorised"),
    )


def folders_from_totals(totals: DataFrame, device: str, depth: int = 0) -> DataFrame:
    """The rows of ``folders.folders_at_depth``."""
    mine = totals.filter((F.col("device_uid") == device) & (F.col("kind") == ANY) & (F.col("depth") == depth + 1) & F.col("inner"))
    return mine.select("folder").distinct().orderBy("folder")
