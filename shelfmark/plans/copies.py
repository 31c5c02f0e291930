"""Reports on copies of a content: backups, duplicates, whereabouts.

A content may have very many copies.  Counts are taken by grouped aggregates, which combine before the shuffle; joins
that keep single rows have one row per key on their other side, so a hot partition can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import settings
from shelfmark.functions.packing import slim, unpacked_hash
from shelfmark.functions.paths import in_saved_page
from shelfmark.operators.groups import one_per_key, repeated


def _without_backup(cards: DataFrame, device: str, volumes: Sequence[str]) -> DataFrame:
    hashed = cards.filter("sha256 IS NOT NULL")
    saved = hashed.filter(
        (F.col("device_uid") != device) & F.col("device_uid").isin(*volumes) & ~in_saved_page(F.col("f_parent"))
    )
    mine = hashed.filter(F.col("device_uid") == device)
    return mine.join(one_per_key(saved, ["sha256"]), "sha256", "left_anti")


def no_backup(cards: DataFrame, device: str, volumes: Sequence[str], rows: int = settings.BACKUP_ROWS) -> DataFrame:
    """Hashed files of a device whose content is on none of the backup volumes, first by folder and name.

    Copies in a folder that ends with "_files" do not count as backup.
    """
    lost = _without_backup(cards, device, volumes)
    return lost.select("f_parent", "f_name", "f_last_modified_date").orderBy("f_parent", "f_name").limit(rows)


def no_backup_total(cards: DataFrame, device: str, volumes: Sequence[str]) -> DataFrame:
    return _without_backup(cards, device, volumes).agg(F.count(F.lit(1)).alias("files"))


def _reliable_pairs(cards: DataFrame, unreliable: Sequence[str]) -> DataFrame:
    """Distinct (sha256, device_uid) of hashed files on reliable devices.

    Copies are cut to these by hash, so the minimum of texts, which Spark sorts for, meets no more rows.
    """
    hashed = cards.filter("sha256 IS NOT NULL")
    reliable = hashed.filter(~F.col("device_uid").isin(*unreliable)) if unreliable else hashed
    return reliable.select("sha256", "device_uid").distinct()


def _held(pairs: DataFrame, not_view: Sequence[str], few: DataFrame) -> DataFrame:
    """``few`` with one reliable device that holds the content; rows with none or one not to be viewed drop."""
    holder = one_per_key(pairs, ["sha256"], F.min("device_uid").alias("device_uid")).filter("device_uid IS NOT NULL")
    if not_view:
        holder = holder.filter(~F.col("device_uid").isin(*not_view))
    return few.join(holder, "sha256")


def few_copies_by_category(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, unreliable: Sequence[str] = (),
    not_view: Sequence[str] = (), copies: int = settings.MIN_COPIES, rows: int = settings.BACKUP_ROWS,
) -> DataFrame:
    """Categorised contents with fewer than ``copies`` copies, and the first reliable device that holds the content."""
    groups = (
        cards.filter("sha256 IS NOT NULL").groupBy("sha256", "f_name").agg(F.count(F.lit(1)).alias("n"))
    )
    few = (
        groups.filter(F.col("n") < copies).select("sha256", "f_name")
        # Categories grow with the contents, and hashes take far more memory than the size they are estimated by.
        .join(categories.hint("merge"), ["sha256", "f_name"])
        .join(rules.select("id", "category_type", "description"), "id")
    )
    return (
        _held(_reliable_pairs(cards, unreliable), not_view, few)
        .select("sha256", "f_name", "category_type", "description", "device_uid")
        .orderBy("sha256", "f_name").limit(rows)
    )


def few_copies_recent(
    cards: DataFrame, unreliable: Sequence[str] = (), not_view: Sequence[str] = (),
    copies: int = settings.MIN_COPIES, rows: int = settings.BACKUP_ROWS, as_of: Column | None = None,
) -> DataFrame:
    """(content, name, time) groups with fewer than ``copies`` files, newest first.

    The report takes all files; with ``as_of`` only those since the start of that month a year before.
    """
    hashed = cards.filter("sha256 IS NOT NULL")
    groups = hashed.groupBy("sha256", "f_name", "f_last_modified_date").agg(F.count(F.lit(1)).alias("n"))
    few = groups.filter(F.col("n") < copies).select("sha256", "f_name", "f_last_modified_date")
    if as_of is not None:
        few = few.filter(F.col("f_last_modified_date") >= F.date_trunc("month", as_of) - F.make_ym_interval(F.lit(1)))
    return (
        _held(_reliable_pairs(cards, unreliable), not_view, few)
        .select("sha256", "f_name", "device_uid", "f_last_modified_date")
        .orderBy(F.desc("f_last_modified_date"), "sha256", "f_name").limit(rows)
    )


def duplicates(cards: DataFrame, device: str, max_size: int = settings.DUPLICATE_SIZE) -> DataFrame:
    """Contents above a size that a device holds more than once under one name."""
    big = cards.filter(
        (F.col("device_uid") == device) & (F.col("f_size") > 0) & (F.col("f_size") > max_size)
        & F.col("sha256").isNotNull()
    )
    return (
        big.groupBy("sha256", "f_name", "f_size").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        .orderBy(F.desc("copies"), F.desc("f_size"), "sha256", "f_name")
    )


def copies_on_device(
    cards: DataFrame, categories: DataFrame, rules: DataFrame, device: str, sha256: str
) -> DataFrame:
    """Copies of a content on a device with the category type and description of each."""
    wanted = F.col("sha256") == sha256
    named = (
        categories.filter(wanted)
        .join(rules.select("id", "category_type", "description"), "id", "left")
        .select("f_name", "category_type", "description")
    )
    return (
        cards.filter((F.col("device_uid") == device) & wanted)
        .select("id", "f_name", "f_parent", "f_last_modified_date")
        .join(named, "f_name", "left")
        .select("id", "f_name", "f_parent", "f_last_modified_date", "category_type", "description")
        .orderBy("f_parent", "id")
    )


def _not_catalogued(names: DataFrame, cards: DataFrame) -> DataFrame:
    """(f_name, n) of the photos and videos on a name list, listed n times more often than the catalogue has them."""
    photos = names.filter(F.col("f_name").startswith("IMG_") | F.col("f_name").startswith("VID_"))
    listed = photos.groupBy("f_name").agg(F.count(F.lit(1)).alias("listed"))
    known = cards.groupBy("f_name").agg(F.count(F.lit(1)).alias("known"))
    missing = F.col("listed") - F.coalesce("known", F.lit(0))
    return listed.join(known, "f_name", "left").select("f_name", missing.alias("n")).filter("n > 0")


def names_not_catalogued(
    names: DataFrame, cards: DataFrame,
    copy_from: str = settings.COPY_FROM, copy_to: str = settings.COPY_TO,
) -> DataFrame:
    """Copy commands for the photos and videos on a name list that the catalogue lacks.

    A name counts as often as it is listed, and each catalogued file takes one listing away.
    """
    command = F.concat(F.lit(f"adb pull {copy_from}"), "f_name", F.lit(f" {copy_to}"), "f_name")
    return repeated(_not_catalogued(names, cards), "n").select("f_name", command.alias("command"))


def names_not_catalogued_total(names: DataFrame, cards: DataFrame) -> DataFrame:
    """How many commands ``names_not_catalogued`` gives."""
    return _not_catalogued(names, cards).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("commands"))


def duplicate_content_overview(cards: DataFrame) -> DataFrame:
    """Per content and lower-case name: number of files, devices and folders as text, most files first.

    Each group is one row (``part`` 0) with all of its folders, which one task holds; ``duplicate_content_places`` has
    them as rows.
    """
    keys = ["sha256", "f_name_lc"]
    hashed = cards.filter("sha256 IS NOT NULL AND f_name_lc IS NOT NULL").select(*keys, "device_uid", "f_parent")

    def text(name: str) -> Column:
        return F.array_join(F.array_sort(name), ", ").alias(name)

    # Sets are begun before the one shuffle, so a content on very many files comes as one row of each task.
    groups = slim(hashed).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.collect_set("device_uid").alias("devices"),
        F.collect_set("f_parent").alias("folders"),
    ).filter(F.size("folders") > 0)
    return (
        groups.select(
            "f_name_lc", unpacked_hash(F.col("sha256")).alias("sha256"), F.lit(0).alias("part"), "files",
            text("devices"), text("folders"),
        )
        .orderBy(F.desc("files"), "sha256", "f_name_lc", "part")
    )


def duplicate_content_places(cards: DataFrame) -> DataFrame:
    """The distinct places (sha256, f_name_lc, device_uid, f_parent) of each content and lower-case name, sorted."""
    places = ["sha256", "f_name_lc", "device_uid", "f_parent"]
    return cards.filter("sha256 IS NOT NULL").select(*places).distinct().orderBy(*places)


def locate_copy(cards: DataFrame, mounted: DataFrame, sha256: str) -> DataFrame:
    """The first copy of a content by id on a mounted device (uuid, mountpoint), with its full path."""
    copies = cards.filter(F.col("sha256") == sha256)
    where = mounted.select(F.col("uuid").alias("device_uid"), "mountpoint")
    full = F.concat(F.rtrim(F.col("mountpoint"), F.lit("/")), F.lit("/"), F.col("f_parent"), F.col("f_name"))
    return (
        copies.join(where, "device_uid")
        .orderBy("id").limit(1)
        .select("id", "device_uid", "f_parent", "f_name", "f_mime_type_java", full.alias("path"))
    )


def file_by_natural_key(cards: DataFrame, device: str, path: str, name: str) -> DataFrame:
    exact = (F.col("device_uid") == device) & (F.col("f_parent") == path) & (F.col("f_name") == name)
    return cards.filter(exact).select("device_uid", "f_parent", "f_name", "f_mime_type_java")


def paths_by_hash(cards: DataFrame, sha256: str) -> DataFrame:
    return cards.filter(F.col("sha256") == sha256).select("f_name", "f_parent", "device_uid")


def paths_sharing_content(cards: DataFrame, parent: str) -> DataFrame:
    """All folders that hold a content which also lies in the given folder, with the number of such files."""
    contents = one_per_key(cards.filter((F.col("f_parent") == parent) & F.col("sha256").isNotNull()), ["sha256"])
    hashed = cards.filter("sha256 IS NOT NULL").select("sha256", "device_uid", "f_parent")
    return (
        hashed.join(contents, "sha256", "left_semi")
        .groupBy("device_uid", "f_parent").agg(F.count(F.lit(1)).alias("files"))
        .orderBy("f_parent", "device_uid")
    )
