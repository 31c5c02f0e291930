"""Thumbnails: which are missing, and what they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators.metadata import PHOTO


def thumbnail_worklist(cards: DataFrame, images: DataFrame, device: str) -> DataFrame:
    """Hashed photos of a device whose content and name has no thumbnail, each content and name once.

    Any copy serves as the original; the first by folder is taken.
    """
    photos = cards.filter(
        (F.col("device_uid") == device) & (F.col("f_mime_type_java") == PHOTO) & F.col("sha256").isNotNull()
    )
    once = photos.groupBy("sha256", "f_name").agg(F.min(F.struct("f_parent", "f_extension")).alias("original"))
    missing = once.join(images.select("sha256", "f_name"), ["sha256", "f_name"], "left_anti")
    return missing.select("original.f_parent", "f_name", "original.f_extension", "sha256")


def thumbnail_keys(work: DataFrame) -> DataFrame:
    """Rows for the table of thumbnails: (sha256, f_name, file_id), with the cache path of each."""
    key = paths.thumbnail_key(F.col("sha256"), F.col("f_name"), F.col("f_extension"))
    return work.select(
        "sha256", "f_name", key.alias("file_id"), paths.thumbnail_path(F.col("sha256"), key).alias("cache_path")
    )
