"""From a directory listing to directories and file cards.

The input is a table of everything a scanner met (``schema.LISTING``): paths are relative to the mount point, and a
directory's path ends with "/".  Directories need no row of their own when a file below them is listed.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators.groups import one_per_key
from shelfmark.operators.prefixes import with_prefix
from shelfmark.session import shared_dir, task_count
from shelfmark.settings import EXCLUDED_DIRS, EXCLUDED_FILES, MIME_TYPES


_FOUND = "folder string, path string, is_dir boolean, length bigint, modified timestamp"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a plain path or as a URI of any file system Arrow knows."""
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def store_and_path(path: str) -> tuple[str, str]:
    """A file system, "/" or a URI's beginning, and the path there of a qualified path: its names are no URI's."""
    store, rest = re.fullmatch(r"((?:[A-Za-z0-9+.-]+:)?(?://[^/]*)?)(/.*)", path, re.DOTALL).groups()
    return ("/" if store in ("", "file:", "file://") else f"{store}/"), rest


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is directory, bytes, nanoseconds) of a folder; one that went in the meantime has none."""
    store, path = store_and_path(folder)
    if store != "/":
        files, base = open_folder(store)
        for info in files.get_file_info(fs.FileSelector(f"{base.rstrip('/')}{path}", allow_not_found=True)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, info.mtime_ns or 0
        return
    try:
        with os.scandir(path) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    about = entry.stat()
                except (FileNotFoundError, UnicodeEncodeError):
                    continue
                yield entry.name, entry.is_dir(), about.st_size if entry.is_file() else 0, about.st_mtime_ns
    except FileNotFoundError:
        return


def _hidden(name: str, is_dir: bool) -> bool:
    led = name.startswith(".") or (name.startswith("_") and "=" not in name)
    metadata = is_dir and name.startswith(("_metadata", "_common_metadata"))
    return (led or name.endswith("._COPYING_")) and not metadata


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is directly in each folder (folder, path)."""
    for batch in batches:
        for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            entries = ((f"{path}{name}", is_dir, size, at // 1_000_000) for name, is_dir, size, at in _entries(folder + path)
                       if not _hidden(name, is_dir) and (is_dir or size))
            while some := list(islice(entries, 10_000)):
                names, dirs, sizes, dates = zip(*some)
                paths = [name + "/" * is_dir for name, is_dir in zip(names, dirs)]
                columns = [
                    pa.array([folder] * len(some)), pa.array(paths), pa.array(dirs), pa.array(sizes, pa.int64()),
                    pa.array(dates, pa.timestamp("ms", "UTC")).cast(pa.timestamp("us", "UTC")),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["folder", "path", "is_dir", "length", "modified"])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(folder, path, length, modified) of the files below a folder, a file or what a pattern matches, each once.

    ``folder`` is the qualified start and ends with "/", ``path`` goes on from there.  Left out are empty files and names
    led by "_" or ".", with all below them, as in Spark's file source, and local names that are no UTF-8.  That source
    sends its list through the driver; here tasks list the folders of one depth after the other and store what they
    find in the shared folder, and the driver knows the starts alone.
    """
    start = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = start.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [files.getFileStatus(start)] if files.exists(start) else list(files.globStatus(start) or [])
    if not found:
        raise FileNotFoundError(root)
    starts = []
    for status in found:
        at = files.makeQualified(status.getPath())
        name, folder = at.getName(), at.toString().rstrip("/") + "/"
        if status.isDirectory():
            starts.append((folder, "", True, 0, None))
        elif status.getLen() and not _hidden(name, False):
            when = dt.datetime.fromtimestamp(status.getModificationTime() / 1000, dt.timezone.utc)
            starts.append((at.getParent().toString().rstrip("/") + "/", name, False, status.getLen(), when))
    base, depth, level = shared_dir(spark, "listing"), 0, spark.createDataFrame(starts, _FOUND)
    level.write.parquet(f"{base}/depth=0")
    while not (dirs := spark.read.schema(_FOUND).parquet(f"{base}/depth={depth}").filter("is_dir")).isEmpty():
        depth += 1
        spread = dirs.select("folder", "path").repartition(task_count(spark), "folder", "path")
        spread.mapInArrow(_listed, _FOUND).write.parquet(f"{base}/depth={depth}")
    whole = spark.read.schema(f"{_FOUND}, depth int").parquet(base)
    return whole.filter("NOT is_dir").select("folder", "path", "length", "modified")


def listing_of_folder(spark: SparkSession, root: str, device: str) -> DataFrame:
    """Listing of a mounted folder; only names, sizes and dates are read.

    Files have no creation time there; for what is left out see ``files_below``.
    """
    files = files_below(spark, root)
    when = F.col("modified").cast("timestamp_ntz")
    return files.select(
        F.lit(device).alias("device_uid"),
        "path",
        F.col("length"),
        when.alias("creation_time"),
        when.alias("modification_time"),
        F.lit(False).alias("denied"),
    )


def listed_dirs(listing: DataFrame) -> DataFrame:
    """Every directory listed or implied: (device_uid, f_parent)."""
    own = listing.select("device_uid", paths.folder_of(F.col("path")).alias("folder")).distinct()
    parts = F.split(F.col("folder"), "/")
    depth = F.size(parts) - 1
    ancestors = F.transform(
        F.sequence(F.lit(0), depth),
        lambda n: F.when(n == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))
        ),
    )
    return own.select("device_uid", F.explode(ancestors).alias("f_parent")).distinct()


def _walked(start_folder: Column, folder: Column) -> Column:
    """Names tested on the way down: the start directory's own and all below it."""
    above = F.length(start_folder) - F.length(F.substring_index(F.rtrim(start_folder, F.lit("/")), "/", -1)) - 1
    below = F.substring(folder, F.greatest(above, F.lit(0)) + 1, F.length(folder))
    return F.split(F.rtrim(below, F.lit("/")), "/")


def scan_dirs(
    listing: DataFrame, starts: DataFrame, excluded: Sequence[str] = EXCLUDED_DIRS
) -> DataFrame:
    """Directories at or below the start paths: (device_uid, f_parent), each once.

    ``starts`` holds (device_uid, path).  A directory whose name contains "_files" or is on the list hides its
    whole subtree, the start directory included.  A start path that is not listed gives no rows.
    """
    trimmed = F.trim(F.col("path"), F.lit("/"))
    begin = F.when(trimmed == "", F.lit("")).otherwise(F.concat(trimmed, F.lit("/")))
    wanted = one_per_key(starts.select("device_uid", begin.alias("start")), ["device_uid", "start"])
    pairs = with_prefix(listed_dirs(listing), "f_parent", wanted, "start", on=["device_uid"])
    names = _walked(F.col("start"), F.col("f_parent"))
    hidden = F.exists(names, lambda name: name.contains("_files") | name.isin(*excluded)) if excluded else F.exists(
        names, lambda name: name.contains("_files")
    )
    return pairs.filter(~hidden).select("device_uid", "f_parent").distinct()


def scan_files(
    listing: DataFrame, excluded: Sequence[str] = EXCLUDED_FILES, mime_types: Mapping[str, str] = MIME_TYPES
) -> DataFrame:
    """File cards of the listed files, without a content hash.

    Names on the list and files with the extension "class" stay out.  ``mime_types`` gives the media type by lower-case
    extension; pass ``{**settings.MIME_TYPES, "heic": "image/heic"}`` for more of them.
    """
    name = paths.base_name(F.col("path"))
    ext = paths.extension(name)
    parent = paths.folder_of(F.col("path"))
    kept = (name != "") & ~F.coalesce(ext == "class", F.lit(False))
    if excluded:
        kept = kept & ~name.isin(*excluded)
    return listing.filter(kept).select(
        paths.file_id(F.col("device_uid"), parent, name).alias("id"),
        "device_uid",
        parent.alias("f_parent"),
        name.alias("f_name"),
        ext.alias("f_extension"),
        F.col("creation_time").alias("f_creation_date"),
        F.col("modification_time").alias("f_last_modified_date"),
        F.col("length").alias("f_size"),
        paths.mime_type(ext, mime_types).alias("f_mime_type_java"),
        F.lit(None).cast("string").alias("sha256"),
        F.lower(name).alias("f_name_lc"),
    )


def folder_text(path: str) -> str:
    """A folder as listings write it; "#" and "/" stand for the mount point."""
    inner = "" if path == "#" else path.strip("/")
    return inner + "/" if inner else ""


def child_dirs(listing: DataFrame, device: str, path: str = "#") -> DataFrame:
    """Directories directly below ``path``: (f_parent without trailing "/", denied)."""
    base = folder_text(path)
    below = listing.filter((F.col("device_uid") == device) & F.col("path").startswith(base))
    rest = F.substring(F.col("path"), F.lit(len(base) + 1), F.length(F.col("path")))
    at_child = F.length(rest) == F.length(F.substring_index(rest, "/", 1)) + 1
    return (
        below.filter(rest.contains("/"))
        .groupBy(F.concat(F.lit(base), F.substring_index(rest, "/", 1)).alias("f_parent"))
        .agg(F.coalesce(F.max(F.col("denied") & at_child), F.lit(False)).alias("denied"))
    )
