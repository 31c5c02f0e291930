"""Reports on photos and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ordering import ascending, descending
from shelfmark.functions.packing import full, packed_hash, slim
from shelfmark.functions.paths import thumbnail_key, thumbnail_path
from shelfmark.functions.text import timestamp_text
from shelfmark.operators.metadata import PHOTO
from shelfmark.settings import IMAGE_ROWS


def exif_devices(cards: DataFrame, exif: DataFrame) -> DataFrame:
    """Cameras (make, model) with their newest file and number of files, newest first."""
    seen = cards.select("id", "f_last_modified_date").join(exif.select("id", "make", "model"), "id")
    return (
        seen.groupBy("make", "model")
        .agg(
            timestamp_text(F.max("f_last_modified_date")).alias("newest"),
            F.count(F.lit(1)).alias("files"),
        )
        .orderBy(descending("newest"))
    )


def files_of_exif_device(
    cards: DataFrame, devices: DataFrame, exif: DataFrame, make: str, model: str
) -> DataFrame:
    """Files of a camera, newest first; folder and label stand in arrays of one element."""
    taken = exif.filter((F.col("make") == make) & (F.col("model") == model)).select(packed_hash(F.col("id")).alias("id"))
    labels = devices.select(F.col("uid").alias("device_uid"), "label_v")
    shown = cards.select("id", "device_uid", "sha256", "f_name", "f_parent", "f_last_modified_date")
    files = (
        full(slim(shown).join(taken, "id", "left_semi"), shown).join(labels, "device_uid")
        .select("sha256", "f_name", "f_parent", "label_v", "f_last_modified_date").distinct()
    )
    return files.select(
        "sha256", "f_name", F.array("f_parent").alias("folders"), F.array("label_v").alias("labels"),
        timestamp_text(F.col("f_last_modified_date")).alias("modified"),
    ).orderBy(descending("modified"), ascending("sha256"), "f_name", "folders", "labels")


def gps_points(cards: DataFrame, exif: DataFrame) -> DataFrame:
    """Full path and coordinates of the files with a place; rows without decimal coordinates are left out."""
    placed = exif.filter(
        "gps_latitude IS NOT NULL AND gps_latitude_dec IS NOT NULL AND gps_longitude_dec IS NOT NULL"
    )
    lat, lon = F.col("gps_latitude_dec").cast("double"), F.col("gps_longitude_dec").cast("double")
    return (
        cards.select("id", F.concat("f_parent", "f_name").alias("path"))
        .join(placed.select("id", lat.alias("latitude"), lon.alias("longitude")), "id")
        .select("path", "latitude", "longitude")
    )


def _images(cards: DataFrame, device: str, parent: str) -> DataFrame:
    return cards.filter(
        (F.col("device_uid") == device) & (F.col("f_parent") == parent) & F.col("sha256").isNotNull()
        & (F.col("f_mime_type_java") == PHOTO)
    )


def images_of_folder(cards: DataFrame, device: str, parent: str, rows: int = IMAGE_ROWS) -> DataFrame:
    """The newest hashed photos of a folder with the thumbnail of each."""
    key = thumbnail_key(F.col("sha256"), F.col("f_name"), F.col("f_extension"))
    newest = _images(cards, device, parent).orderBy(F.desc("f_last_modified_date"), "id").limit(rows)
    return newest.select(
        key.alias("thumbnail"), thumbnail_path(F.col("sha256"), key).alias("cache_path"), "sha256", "f_name",
        "f_mime_type_java",
    )


def images_of_folder_total(cards: DataFrame, device: str, parent: str) -> DataFrame:
    return _images(cards, device, parent).agg(F.count(F.lit(1)).alias("images"))
