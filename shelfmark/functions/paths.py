"""Names, folders and ids of files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.settings import IMAGE_CACHE, MIME_TYPES


def sha256_text(text: Column) -> Column:
    """Upper-case hex SHA-256 of a text."""
    return F.upper(F.sha2(text, 256))


def file_id(device: Column, parent: Column, name: Column) -> Column:
    """Key of a file card: the hash of device, folder and name joined without a separator."""
    return sha256_text(F.concat(device, parent, name))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """Folder part with its trailing "/"; empty for a file directly below the mount point."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)))


def extension(name: Column) -> Column:
    """Text after the last dot unless that dot leads the name: ".bashrc" has none, "a." an empty one."""
    tail = F.substring_index(name, ".", -1)
    dot_at = F.length(name) - F.length(tail)
    return F.when(dot_at > 1, tail)


def mime_type(ext: Column, types: Mapping[str, str] = MIME_TYPES) -> Column:
    """Media type by lower-case extension, NULL for an extension that is not listed."""
    if not types:
        return F.lit(None).cast("string")
    pairs = [F.lit(part) for item in sorted(types.items()) for part in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(ext))


def segment(path: Column, position: int) -> Column:
    """The 1-based part of a path, empty beyond its end."""
    return F.split_part(path, F.lit("/"), F.lit(position))


def thumbnail_key(sha256: Column, name: Column, ext: Column) -> Column:
    suffix = F.when(F.coalesce(ext, F.lit("")) != "", F.concat(F.lit("."), ext)).otherwise(F.lit(""))
    return F.concat(sha256, F.lit("_"), sha256_text(name), suffix)


def thumbnail_path(sha256: Column, key: Column) -> Column:
    """Place of a thumbnail in the cache: grouped by the first two characters of the content hash."""
    return F.concat_ws("/", F.lit(IMAGE_CACHE), F.substring(sha256, 1, 2), key)


def in_saved_page(parent: Column) -> Column:
    """Folder whose text ends with "_files", the marker of a saved web page."""
    return parent.endswith("_files")
