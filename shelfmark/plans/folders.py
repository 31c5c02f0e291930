"""Reports that walk a device's folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import segment
from shelfmark.functions.text import mebibytes
from shelfmark.operators.groups import one_per_key
from shelfmark.sources.listing import child_dirs, folder_text

_CONTENT = ["sha256", "f_name"]

# Marks of a folder that cannot be read and of one with a scan path below it.
DENIED_ICON = "images/jstree/stop.png"
BELOW_ICON = "images/jstree/arrow_right.png"


def _types_or_null(sets: Column) -> Column:
    types = F.array_sort(sets)
    return F.when(F.size(types) > 0, types)


def storage_by_folder(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, device: str, depth: int = 1
) -> DataFrame:
    """Per path segment: size in MiB, files, files without a category, and the category types found."""
    groups = (
        cards.filter((F.col("device_uid") == device) & (F.col("f_size") > 0))
        .groupBy(segment(F.col("f_parent"), depth).alias("folder"), *_CONTENT)
        .agg(F.sum("f_size").alias("size"), F.count(F.lit(1)).alias("n"))
    )
    typed = groups.join(categories, _CONTENT, "left").join(
        rules.select("id", "category_type"), "id", "left"
    )
    return (
        typed.groupBy("folder")
        .agg(
            mebibytes(F.sum("size")).alias("size_mib"),
            F.sum("n").alias("files"),
            F.sum(F.when(F.col("category_type").isNull(), F.col("n")).otherwise(0)).alias("uncategorised"),
            _types_or_null(F.collect_set("category_type")).alias("category_types"),
        )
        .orderBy("folder")
    )


def explore_folder(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, device: str, value: str, depth: int
) -> DataFrame:
    """Per path segment below the folder ``value`` at ``depth - 1``: files, uncategorised ones, category types.

    A category is found by content alone, so a file counts once for each name its content is categorised under.
    """
    if depth < 2:
        raise ValueError("depth has to be at least 2: there is no path segment 0")
    parent = F.col("f_parent")
    groups = (
        cards.filter(
            (F.col("device_uid") == device) & ~parent.endswith("_files") & ~parent.endswith("_files/")
            & (segment(parent, depth - 1) == value)
        )
        .groupBy(segment(parent, depth).alias("folder"), "sha256").agg(F.count(F.lit(1)).alias("n"))
    )
    per_content = one_per_key(
        categories.join(rules.select("id", "category_type"), "id", "left"), ["sha256"],
        F.count(F.lit(1)).alias("names"), F.array_sort(F.collect_set("category_type")).alias("types"),
    )
    found = groups.join(per_content, "sha256", "left")
    per_types = found.groupBy("folder", "types").agg(
        F.sum(F.col("n") * F.coalesce("names", F.lit(1))).alias("files"),
        F.sum(F.when(F.col("names").isNull(), F.col("n")).otherwise(0)).alias("uncategorised"),
    )
    return (
        per_types.groupBy("folder")
        .agg(
            F.sum("files").alias("files"),
            F.sum("uncategorised").alias("uncategorised"),
            _types_or_null(F.array_distinct(F.flatten(F.collect_list("types")))).alias("category_types"),
        )
        .orderBy("folder")
    )


def folders_at_depth(cards: DataFrame, device: str, depth: int = 0) -> DataFrame:
    """Distinct folder names at a 0-based depth; trailing separators do not make an empty name."""
    own = cards.filter(F.col("device_uid") == device).select("f_parent").distinct()
    trimmed = F.rtrim(F.col("f_parent"), F.lit("/"))
    parts = F.when((trimmed != "") | (F.col("f_parent") == ""), F.split(trimmed, "/"))
    return own.select(F.get(parts, F.lit(depth)).alias("folder")).filter("folder IS NOT NULL").distinct().orderBy("folder")


def scan_tree(
    listing: DataFrame, scan_paths: DataFrame, device: str, path: str = "#"
) -> DataFrame:
    """Folders below ``path`` as tree nodes: (id, text, icon, children, state).

    ``scan_paths`` holds (device_uid, path).  A folder that is a scan path is selected, one above a scan path and one
    that cannot be read carry an icon.
    """
    base = folder_text(path)
    mine = scan_paths.filter((F.col("device_uid") == device) & F.col("path").startswith(base))
    rest = F.substring(F.col("path"), F.lit(len(base) + 1), F.length(F.col("path")))
    first = F.substring_index(rest, "/", 1)
    marks = mine.groupBy(F.concat(F.lit(base), first).alias("f_parent")).agg(
        F.max(rest == first).alias("selected"), F.max(rest.contains("/")).alias("above")
    )
    nodes = child_dirs(listing, device, path).join(marks, "f_parent", "left")
    denied, yes = F.col("denied"), F.lit(True)
    icon = F.when(denied, DENIED_ICON).when(F.col("above") == yes, BELOW_ICON).otherwise("")
    selected = F.coalesce(F.col("selected"), F.lit(False)) & ~denied
    text = F.when(denied, F.col("f_parent")).otherwise(F.trim(F.element_at(F.split("f_parent", "/"), -1)))
    state = F.struct(F.lit(False).alias("opened"), F.lit(False).alias("disabled"), selected.alias("selected"))
    return nodes.select(
        F.col("f_parent").alias("id"), text.alias("text"), icon.alias("icon"), (~denied).alias("children"),
        state.alias("state"),
    )
