"""Changes of a table: the new snapshot is a function of the old one.

Write a result to a new folder, never to the one being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.packing import full, is_lean, lean, lean_id, packed_hash, slim, whole
from shelfmark.session import write_once


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append; columns the rows lack become NULL."""
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def upsert_rows(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows replace those with the same key, the others are appended; of rows that repeat a key the least one counts."""
    once = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in table.columns if c not in key])).alias("_row"))
    new = once.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in table.columns])
    return delete_rows(table, new, key).unionByName(new)


def update_rows(table: DataFrame, changes: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Set ``fields`` from the change with the same key, NULL included; rows without a change stay as they are.

    Of changes that repeat a key the least one counts, by the fields in their order, NULL first.
    """
    if _by_text_id(table, changes, key):
        new = changes.groupBy(packed_hash(F.col("id")).alias("_key")).agg(F.min(F.struct(*fields)).alias("_new"))
        joined = by_id(table, new, "left", "_new")
    else:
        new = changes.groupBy(*key).agg(F.min(F.struct(*fields)).alias("_new"))
        joined = table.join(new, list(key), "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in table.columns
        ]
    )


def by_id(table: DataFrame, other: DataFrame, how: str, *more: str) -> DataFrame:
    """The table joined with rows that have a packed id as ``_key``; ``more`` columns of those are added.

    File cards are shuffled without the id, which follows from what they carry.
    """
    if is_lean(table):
        return whole(lean(table).join(other, lean_id(table) == F.col("_key"), how), table, *more)
    return full(slim(table).join(other, F.col("id") == F.col("_key"), how), table, *more)


def _by_text_id(table: DataFrame, other: DataFrame, key: Sequence[str]) -> bool:
    """Whether the key is a text id on both sides, which joins by its packed form."""
    return list(key) == ["id"] and all(df.schema["id"].dataType.simpleString() == "string" for df in (table, other))


def update_where(table: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns of the rows that meet a condition."""
    return table.withColumns(
        {c: F.when(condition, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    )


def delete_rows(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    if _by_text_id(table, keys, key):
        return by_id(table, keys.select(packed_hash(F.col("id")).alias("_key")), "left_anti")
    return table.join(keys.select(*key), list(key), "left_anti").select(*table.columns)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Drop rows that meet the condition; a condition that is NULL keeps the row."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def cascade_files(files: DataFrame, exif: DataFrame) -> DataFrame:
    """Metadata rows whose file is still there."""
    return exif.join(files.select("id"), "id", "left_semi")


def cascade_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Category rows whose rule is still there."""
    return categories.join(rules.select("id"), "id", "left_semi")


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document; NULL fields are written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_snapshot(df: DataFrame, path: str, sort: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a new snapshot, its rows cut into ranges of the sort columns and sorted within each file.

    A value that a large part of all rows shares, say a device, still becomes many files when a later sort column
    tells its rows apart.
    """
    if sort and is_lean(df):
        ranges = [lean_id(df) if c == "id" else c for c in sort]
        df = whole(lean(df).repartitionByRange(*ranges), df).sortWithinPartitions(*sort)
    elif sort:
        df = full(slim(df).repartitionByRange(*sort), df).sortWithinPartitions(*sort)
    write_once(df, path, mode)


def write_file_cards(cards: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """File cards sorted by device and folder: a report on one of them skips the row groups of all others.

    Devices are not made folders of the file system, since there may be very many small ones.
    """
    write_snapshot(cards, path, ["device_uid", "f_parent", "id"], mode)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save as a table bucketed by a key.

    Tables bucketed alike by the file id, such as file cards and their metadata, join without a shuffle.  Choose a
    unique key: rows of one bucket are read by one task.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_script(lines: DataFrame, path: str, replace: bool = False) -> None:
    """A text script as a single file; ``replace`` puts it in the place of an earlier one.

    The lines pass one task, so this fits lists a person will run.
    """
    lines.coalesce(1).write.mode("overwrite" if replace else "errorifexists").text(path)
