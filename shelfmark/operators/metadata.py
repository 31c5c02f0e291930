"""Photo and video metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.media_dates import moment, names_photo_date, photo_fields, video_fields, weekday_fits
from shelfmark.schema import EXIF

# Media types with metadata, the tags read from each, and the columns they fill.
PHOTO, VIDEO = "image/jpeg", "video/mp4"
PHOTO_DATES = {
    "Date/Time": "date_time", "Date/Time Original": "date_time_original", "Date/Time Digitized": "date_time_digitized",
}
VIDEO_DATES = {"Creation Time": "date_time", "Modification Time": "date_time_original"}
PHOTO_TEXTS = {
    "Make": "make", "Model": "model", "Software": "software", "Exif Image Width": "exif_image_width",
    "Exif Image Height": "exif_image_height", "GPS Version ID": "gps_version_id",
    "GPS Latitude Ref": "gps_latitude_ref", "GPS Latitude": "gps_latitude", "GPS Longitude Ref": "gps_longitude_ref",
    "GPS Longitude": "gps_longitude", "GPS Altitude Ref": "gps_altitude_ref", "GPS Altitude": "gps_altitude",
    "GPS Time-Stamp": "gps_time_stamp", "GPS Processing Method": "gps_processing_method",
    "GPS Date Stamp": "gps_date_stamp",
}
LATITUDE, LONGITUDE = "gpsLatitudeD", "gpsLongitudeD"


def exif_worklist(cards: DataFrame, exif: DataFrame, device: str) -> DataFrame:
    """Photos and videos of a device without a metadata row."""
    media = cards.filter((F.col("device_uid") == device) & F.col("f_mime_type_java").isin(PHOTO, VIDEO))
    return media.join(exif.select("id"), "id", "left_anti").select("id", "f_parent", "f_name", "f_mime_type_java")


def exif_normalize(files: DataFrame, tags: DataFrame) -> DataFrame:
    """One metadata row per file from its tags.

    ``files`` holds (id, f_mime_type_java), ``tags`` (id, tag, value) with the coordinates as decimal text under
    "gpsLatitudeD" and "gpsLongitudeD".  A file without tags gives a row of NULLs, so it is not tried again; a file
    with a date that cannot be read gives none.  The point 0, 0 counts as no coordinates.
    """
    media = files.filter(F.col("f_mime_type_java").isin(PHOTO, VIDEO))
    # The few tags of a file are one list; a maximum per tag would sort all tags of all files.
    tag = F.struct("tag", "value", "moment", "broken")
    listed = _dates(tags).join(media.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list(tag).alias("tags"))

    def most(name: str, field: str) -> Column:
        return F.array_max(F.transform(F.filter("tags", lambda t: t["tag"] == name), lambda t: t[field]))

    def any_broken(names) -> Column:
        return F.exists("tags", lambda t: t["broken"] & t["tag"].isin(*names))

    texts = {**PHOTO_TEXTS, LATITUDE: "lat", LONGITUDE: "lon"}
    per_file = listed.select(
        "id", *[most(t, "moment").alias(f"photo_{c}") for t, c in PHOTO_DATES.items()],
        *[most(t, "moment").alias(f"video_{c}") for t, c in VIDEO_DATES.items()],
        *[most(t, "value").alias(c) for t, c in texts.items()],
        any_broken(PHOTO_DATES).alias("photo_broken"), any_broken(VIDEO_DATES).alias("video_broken"),
    )
    rows = media.join(per_file, "id", "left")
    photo = F.col("f_mime_type_java") == PHOTO
    broken = F.when(photo, F.col("photo_broken")).otherwise(F.col("video_broken"))
    columns = {c: F.when(photo, F.col(f"photo_{c}")) for c in PHOTO_DATES.values()}
    columns |= {c: columns[c].otherwise(F.col(f"video_{c}")) for c in VIDEO_DATES.values()}
    columns |= {c: F.when(photo, F.col(c)) for c in PHOTO_TEXTS.values()}
    lat, lon = (F.col(c).try_cast("decimal(38,18)") for c in ("lat", "lon"))
    located = photo & lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    columns |= {"gps_latitude_dec": F.when(located, lat), "gps_longitude_dec": F.when(located, lon)}
    return rows.filter(~F.coalesce(broken, F.lit(False))).select(
        "id", *[columns[f.name].cast(f.dataType).alias(f.name) for f in EXIF.fields if f.name != "id"]
    )


def _dates(tags: DataFrame) -> DataFrame:
    """The tags that are read, with the moment each date tag names and whether it is broken."""
    value, is_photo = F.col("value"), F.col("tag").isin(*PHOTO_DATES)
    is_video = F.col("tag").isin(*VIDEO_DATES)
    read = tags.filter(F.col("tag").isin(*PHOTO_DATES, *VIDEO_DATES, *PHOTO_TEXTS, LATITUDE, LONGITUDE))
    fields = F.when(is_photo & names_photo_date(value), photo_fields(value)).when(is_video, video_fields(value))
    dated = read.select("id", "tag", "value", fields.alias("fields"))
    fits = is_photo | (is_video & weekday_fits(value, F.col("fields")))
    placed = dated.select("id", "tag", "value", F.when(fits, moment(F.col("fields"))).alias("moment"))
    meant = (is_photo & names_photo_date(value)) | (is_video & value.isNotNull())
    return placed.withColumn("broken", F.coalesce(meant & F.col("moment").isNull(), F.lit(False)))
