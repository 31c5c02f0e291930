"""Reports on devices and the files they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ordering import ascending
from shelfmark.functions.paths import in_saved_page
from shelfmark.settings import DEVICE_ROWS, PATH_ROWS

_SHOWN = ["f_parent", "f_name", "f_last_modified_date"]


def _unhashed(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("sha256").isNull() & (F.col("f_size") > 0))


def device_index(devices: DataFrame, cards: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Visible devices by label, with their unhashed files and the days since the last scan (NULL: never)."""
    today = F.current_date() if as_of is None else as_of
    open_files = _unhashed(cards).groupBy(F.col("device_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    return (
        devices.filter("visible")
        .join(open_files, "uid", "left")
        .select(
            "name", "label_v", "uid", "description", "path_scan_date", "reliable",
            F.coalesce("n", F.lit(0)).alias("without_hash"),
            F.datediff(today, F.col("path_scan_date")).alias("days_since_scan"),
        )
        .orderBy("label_v")
    )


def device_list(devices: DataFrame) -> DataFrame:
    return devices.select(
        "name", "label_v", "uid", "description", "path_scan_date", "visible", "reliable"
    ).orderBy("label_v")


def files_of_device(cards: DataFrame, device: str, rows: int = DEVICE_ROWS) -> DataFrame:
    """The first files of a device by id."""
    mine = cards.filter(F.col("device_uid") == device)
    return mine.select("id", *_SHOWN).orderBy("id").limit(rows).select(*_SHOWN)


def files_of_device_by_date(cards: DataFrame, device: str, rows: int = DEVICE_ROWS) -> DataFrame:
    """The newest files of a device outside saved web pages."""
    mine = cards.filter((F.col("device_uid") == device) & ~in_saved_page(F.col("f_parent")))
    return mine.select("id", *_SHOWN).orderBy(F.desc("f_last_modified_date"), "id").limit(rows).select(*_SHOWN)


def count_by_device(cards: DataFrame) -> DataFrame:
    return cards.groupBy("device_uid").agg(F.count(F.lit(1)).alias("files")).orderBy("device_uid")


def debug_unhashed(devices: DataFrame, cards: DataFrame, label: str) -> DataFrame:
    """Unhashed files per (label, scan date), matching a device's label, not its uid, with the files."""
    labelled = devices.filter(F.col("label_v") == label).select("label_v", "path_scan_date")
    per_device = (
        _unhashed(cards).filter(F.col("device_uid") == label)
        .groupBy(F.col("device_uid").alias("label_v")).agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        labelled.join(per_device, "label_v")
        .groupBy("label_v", "path_scan_date").agg(F.sum("n").alias("files"))
        .orderBy("label_v", ascending("path_scan_date"))
    )


def files_under_path(cards: DataFrame, device: str, path: str, rows: int = PATH_ROWS) -> DataFrame:
    """Files in a folder given without its trailing "/", or below it."""
    inside = (F.col("f_parent") == path) | F.col("f_parent").startswith(path + "/")
    mine = cards.filter((F.col("device_uid") == device) & inside)
    return mine.select("id", *_SHOWN).orderBy("id").limit(rows).select(*_SHOWN)


def files_without_hash(cards: DataFrame, device: str, rows: int = DEVICE_ROWS) -> DataFrame:
    """The newest unhashed files of a device."""
    mine = _unhashed(cards).filter(F.col("device_uid") == device)
    return mine.select("id", *_SHOWN).orderBy(F.desc("f_last_modified_date"), "id").limit(rows).select(*_SHOWN)


def files_without_hash_total(cards: DataFrame, device: str) -> DataFrame:
    return _unhashed(cards).filter(F.col("device_uid") == device).agg(F.count(F.lit(1)).alias("files"))
