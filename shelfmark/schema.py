"""Column types of the catalogue tables.

Timestamps carry no zone, so the wall clock a device reported is kept whatever the session zone is.  A device that was
never scanned has a NULL scan date.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in columns])


FILE_CARD = _table(
    ("id", _S, True), ("device_uid", _S, True), ("f_parent", _S, True), ("f_name", _S, True),
    ("f_extension", _S, False), ("f_creation_date", _TS, True), ("f_last_modified_date", _TS, True),
    ("f_size", _L, False), ("f_mime_type_java", _S, False), ("sha256", _S, False), ("f_name_lc", _S, True),
)

DEVICE = _table(
    ("id", _I, True), ("uid", _S, True), ("name", _S, True), ("label_v", _S, True), ("name_v", _S, False),
    ("description", _S, False), ("visible", _B, True), ("reliable", _B, True), ("path_scan_date", _TS, False),
    ("crc_date", _TS, False), ("exif_date", _TS, False), ("job_path_scan", _B, True), ("job_calc_crc", _B, True),
    ("job_calc_exif", _B, True), ("job_resize", _B, True),
)

CATEGORY_RULE = _table(
    ("id", _I, True), ("category_type", _S, True), ("category", _S, True), ("sub_category", _S, True),
    ("f_path", T.ArrayType(_S), True), ("is_begins", _B, True), ("description", _S, False),
)

CATEGORY_FC = _table(("id", _I, True), ("sha256", _S, True), ("f_name", _S, True))

EXIF_TEXT_COLUMNS = (
    "make", "model", "software", "exif_image_width", "exif_image_height", "gps_version_id", "gps_latitude_ref",
    "gps_latitude", "gps_longitude_ref", "gps_longitude", "gps_altitude_ref", "gps_altitude", "gps_time_stamp",
    "gps_processing_method", "gps_date_stamp",
)
EXIF = _table(
    ("id", _S, True), ("date_time", _TS, False), ("date_time_original", _TS, False),
    ("date_time_digitized", _TS, False), *[(name, _S, False) for name in EXIF_TEXT_COLUMNS],
    ("gps_latitude_dec", T.DecimalType(38, 18), False), ("gps_longitude_dec", T.DecimalType(38, 18), False),
)

IMAGE_RESIZE = _table(("sha256", _S, True), ("f_name", _S, True), ("file_id", _S, True))

JOB_PATH_MOVE = _table(
    ("id", _I, True), ("device_uid", _S, True), ("path_from", _S, True), ("path_to", _S, True), ("done", _TS, False),
)

# One row per file or directory a scanner met; a directory's path ends with "/".
LISTING = _table(
    ("device_uid", _S, True), ("path", _S, True), ("length", _L, False), ("creation_time", _TS, False),
    ("modification_time", _TS, False), ("denied", _B, True),
)

TAGS = _table(("id", _S, True), ("tag", _S, True), ("value", _S, False))

TABLES = {
    "file_card": FILE_CARD, "device": DEVICE, "category_rule": CATEGORY_RULE, "category_fc": CATEGORY_FC,
    "exif": EXIF, "image_resize": IMAGE_RESIZE, "job_path_move": JOB_PATH_MOVE, "listing": LISTING, "tags": TAGS,
}
