"""Reports on categories and on what has none.

Files are reduced to counted groups by (content, name) before they meet the category table, so copies of one content
do not pile up in one task of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import settings
from shelfmark.functions.ordering import ascending, descending
from shelfmark.functions.paths import in_saved_page
from shelfmark.operators.groups import one_per_key

_CONTENT = ["sha256", "f_name"]



def _filled(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("f_size") > 0)


def _uncategorised(files: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows without a category; a file without a content hash has none."""
    return files.join(categories.select(*_CONTENT), _CONTENT, "left_anti")


def big_uncategorised_dirs(
    cards: DataFrame, categories: DataFrame, device: str, max_files: int = settings.CATEGORY_DIR_FILES
) -> DataFrame:
    """Folders of a device with more than ``max_files`` hashed files without a category."""
    parent = F.col("f_parent")
    mine = cards.filter(
        (F.col("device_uid") == device) & F.col("sha256").isNotNull()
        & ~in_saved_page(parent) & ~parent.endswith("_files/")
    )
    groups = mine.groupBy(*_CONTENT, "f_parent").agg(F.count(F.lit(1)).alias("n"))
    return (
        _uncategorised(groups, categories).groupBy("f_parent").agg(F.sum("n").alias("files"))
        .filter(F.col("files") > max_files).orderBy("f_parent")
    )


def count_by_category_type(cards: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Non-empty files per category type; the NULL type stands for files without one."""
    groups = _filled(cards).groupBy(*_CONTENT).agg(F.count(F.lit(1)).alias("n"))
    typed = groups.join(categories, _CONTENT, "left").join(rules.select("id", "category_type"), "id", "left")
    return (
        typed.groupBy("category_type").agg(F.sum("n").alias("files"))
        .orderBy(F.desc("files"), ascending("category_type"))
    )


def _files_per(cards: DataFrame, categories: DataFrame, rules: DataFrame, wanted: Column, level: str) -> DataFrame:
    chosen = categories.join(rules.filter(wanted).select("id", level), "id").select(*_CONTENT, level)
    groups = _filled(cards).filter("sha256 IS NOT NULL").groupBy(*_CONTENT).agg(F.count(F.lit(1)).alias("n"))
    return (
        groups.join(chosen, _CONTENT).groupBy(level).agg(F.sum("n").alias("files"))
        .orderBy(F.desc("files"), ascending(level))
    )


def count_by_category(cards: DataFrame, categories: DataFrame, rules: DataFrame, category_type: str) -> DataFrame:
    return _files_per(cards, categories, rules, F.col("category_type") == category_type, "category")


def count_by_sub_category(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, category_type: str, category: str
) -> DataFrame:
    wanted = (F.col("category_type") == category_type) & (F.col("category") == category)
    return _files_per(cards, categories, rules, wanted, "sub_category")


def uncategorised_dirs_by_date(
    cards: DataFrame, categories: DataFrame, rows: int = settings.CATEGORY_ROWS
) -> DataFrame:
    """Newest date per folder among the newest (folder, time) pairs of files without a category."""
    open_files = _filled(cards).filter(~in_saved_page(F.col("f_parent")))
    once = open_files.select(*_CONTENT, "f_parent", "f_last_modified_date").distinct()
    newest = (
        _uncategorised(once, categories).select("f_parent", "f_last_modified_date").distinct()
        .orderBy(F.desc("f_last_modified_date"), "f_parent").limit(rows)
    )
    return (
        newest.groupBy("f_parent").agg(F.to_date(F.max("f_last_modified_date")).alias("date"))
        .orderBy(F.desc("date"), "f_parent")
    )


def uncategorised_files_by_date(
    cards: DataFrame, categories: DataFrame, rows: int = settings.CATEGORY_ROWS
) -> DataFrame:
    """The newest distinct (content, folder, name, time) without a category."""
    open_files = _filled(cards).filter(~in_saved_page(F.col("f_parent")))
    once = open_files.select("sha256", "f_parent", "f_name", "f_last_modified_date").distinct()
    return (
        _uncategorised(once, categories).select("sha256", "f_parent", "f_name", "f_last_modified_date")
        .orderBy(F.desc("f_last_modified_date"), descending("sha256"), "f_parent", "f_name").limit(rows)
    )


def uncategorised_dirs_by_extension(
    cards: DataFrame, categories: DataFrame, extension: str = "", rows: int = settings.CATEGORY_ROWS
) -> DataFrame:
    """Folders with the most files without a category, of one extension (any case) or of all (empty)."""
    open_files = _filled(cards).filter(~in_saved_page(F.col("f_parent")))
    if extension:
        open_files = open_files.filter(F.lower(F.coalesce("f_extension", F.lit(""))) == extension.lower())
    groups = open_files.groupBy(*_CONTENT, "f_parent").agg(F.count(F.lit(1)).alias("n"))
    return (
        _uncategorised(groups, categories).groupBy("f_parent").agg(F.sum("n").alias("files"))
        .orderBy(F.desc("files"), "f_parent").limit(rows)
    )


def files_with_category(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, parent: str, begins: bool = False
) -> DataFrame:
    """Files in a folder, or with ``begins`` in all folders whose text starts so, with their category."""
    inside = F.col("f_parent").startswith(parent) if begins else F.col("f_parent") == parent
    files = cards.filter(inside).select("device_uid", "f_parent", "f_name", "f_last_modified_date", "sha256")
    levels = ["category_type", "category", "sub_category", "description"]
    named = categories.join(rules.select("id", *levels), "id", "left").select(*_CONTENT, *levels)
    return (
        files.join(named, _CONTENT, "left")
        .select("device_uid", "f_parent", "f_name", "f_last_modified_date", "sha256", *levels)
        .orderBy("device_uid", "f_parent", "f_name")
    )


def paths_of_category(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, jobs: DataFrame,
    category_type: str, category: str, sub_category: str,
) -> DataFrame:
    """Folders with a file of a category: their devices, all their files, and the planned target.

    Of several planned targets the first by text is shown.  A folder's devices are at most the device table's rows.
    """
    wanted = (
        (F.col("category_type") == category_type) & (F.col("category") == category)
        & (F.col("sub_category") == sub_category)
    )
    contents = categories.join(rules.filter(wanted).select("id"), "id", "left_semi").select(*_CONTENT)
    once = cards.filter("sha256 IS NOT NULL").select(*_CONTENT, "f_parent").distinct()
    folders = one_per_key(once.join(contents, _CONTENT, "left_semi"), ["f_parent"])
    per_device = cards.groupBy("f_parent", "device_uid").agg(F.count(F.lit(1)).alias("n"))
    totals = per_device.join(folders, "f_parent", "left_semi").groupBy("f_parent").agg(
        F.array_join(F.array_sort(F.collect_list("device_uid")), ", ").alias("devices"), F.sum("n").alias("files")
    )
    targets = jobs.groupBy(F.col("path_from").alias("f_parent")).agg(F.min("path_to").alias("path_to"))
    return (
        totals.join(targets, "f_parent", "left").select("f_parent", "devices", "files", "path_to")
        .orderBy(F.desc("files"), "f_parent")
    )
