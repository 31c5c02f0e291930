"""Rows of file cards made small for a shuffle, and back.

Ids and content hashes are 64 hex digits that no codec of a shuffle shortens by much, and the lower-case name mostly
follows from the name.  ``slim`` carries a hash as its 32 bytes and a lower-case name only where it is another one;
``full`` restores every value as it was, whatever text it held.  Packed ids are equal where the ids are.

Mostly an id is the hash of device, folder and name, and extension and media type follow from the name as well.  ``lean``
leaves out all that follows from other columns and keeps what does not in one more column; ``lean_id`` is the packed id of
such a row, to join by without shuffling it, and ``whole`` restores the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths

_HASHES = ("id", "sha256")
# Other texts get longer than 32 bytes by this, so the length tells them apart.
_OTHER = bytes(33)


def packed_hash(text: Column) -> Column:
    """The bytes of an upper-case hex SHA-256; any other text as it is, behind a prefix."""
    raw = F.unhex(text)
    is_hash = (F.length(text) == 64) & F.coalesce(F.hex(raw) == text, F.lit(False))
    return F.when(is_hash, raw).otherwise(F.concat(F.lit(_OTHER), text.cast("binary")))


def unpacked_hash(packed: Column) -> Column:
    other = F.substring(packed, len(_OTHER) + 1, 1 << 30).cast("string")
    return F.when(F.length(packed) == 32, F.hex(packed)).otherwise(other)


def _texts(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [name for name in names if name in df.columns and df.schema[name].dataType.simpleString() == "string"]


def slim(df: DataFrame) -> DataFrame:
    """The same rows with packed hashes and without a lower-case name that the name gives."""
    changed = {name: packed_hash(F.col(name)) for name in _texts(df, _HASHES)}
    if len(_texts(df, ("f_name", "f_name_lc"))) == 2:
        same = F.col("f_name_lc").eqNullSafe(F.lower("f_name"))
        changed["f_name_lc"] = F.when(~same, F.coalesce(F.concat(F.lit("="), "f_name_lc"), F.lit("")))
    return df.withColumns(changed) if changed else df


def full(packed: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    """The rows and columns of ``like``, which were passed through ``slim``, and ``more`` columns that a join added."""
    changed = {name: unpacked_hash(F.col(name)) for name in _texts(like, _HASHES)}
    if len(_texts(like, ("f_name", "f_name_lc"))) == 2:
        other = F.when(F.col("f_name_lc") != "", F.substring("f_name_lc", 2, 1 << 30))
        changed["f_name_lc"] = F.when(F.col("f_name_lc").isNull(), F.lower("f_name")).otherwise(other)
    return (packed.withColumns(changed) if changed else packed).select(*like.columns, *more)


# What a lean row leaves out, in the order of its column for those that do not follow from the rest.
_DERIVED = ("id", "f_extension", "f_mime_type_java", "f_name_lc")
_NAMED = ("device_uid", "f_parent", "f_name")
REST = "_rest"


def is_lean(df: DataFrame) -> bool:
    """Whether a table has an id and what it mostly follows from, as texts."""
    return len(_texts(df, ("id", *_NAMED))) == 4


def _derived(name: str, like: DataFrame, col) -> Column | None:
    """What a value mostly is, from the other columns; None where they are not there."""
    if name == "id":
        return paths.file_id(*map(col, _NAMED)) if is_lean(like) else None
    if not _texts(like, ("f_name",)):
        return None
    extension = paths.extension(col("f_name"))
    return {
        "f_extension": extension, "f_mime_type_java": paths.mime_type(extension), "f_name_lc": F.lower(col("f_name")),
    }[name]


def lean(df: DataFrame) -> DataFrame:
    """The same rows without the columns that follow from others; ``_rest`` has those that do not, NULL for none."""
    left_out = _texts(df, _DERIVED)

    def other(name: str) -> Column:
        if name not in left_out:
            return F.lit(None).cast("binary")
        value = packed_hash(F.col(name)) if name == "id" else F.concat(F.lit(b"="), F.col(name).cast("binary"))
        value, derived = F.coalesce(value, F.lit(b"")), _derived(name, df, F.col)
        return value if derived is None else F.when(~F.col(name).eqNullSafe(derived), value)

    others = {f"{REST}{n}": other(name) for n, name in enumerate(_DERIVED)}
    rest = F.when(F.coalesce(*others).isNotNull(), F.array(*others)).alias(REST)
    kept = [packed_hash(F.col(c)).alias(c) if c in _texts(df, ("sha256",)) else F.col(c) for c in df.columns if c not in left_out]
    return df.withColumns(others).select(*kept, rest)


def lean_id(like: DataFrame, at: str = "") -> Column:
    """The packed id of a lean row of the table ``like``, NULL where the id is; ``at`` names the side of a join."""
    other = F.get(F.col(f"{at}{REST}"), F.lit(0))
    given = F.when(F.length(other) > 0, other)
    if not is_lean(like):
        return given
    own = F.unhex(F.sha2(F.concat(*[F.col(f"{at}{c}") for c in _NAMED]), 256))
    return F.when(other.isNull(), own).otherwise(given)


def whole_columns(like: DataFrame, at: str = "") -> dict[str, Column]:
    """The columns of ``like`` from its lean rows; ``at`` names the side of a join."""
    left_out = _texts(like, _DERIVED)

    def col(name: str) -> Column:
        return F.col(f"{at}{name}")

    def column(name: str) -> Column:
        if name == "sha256" and _texts(like, ("sha256",)):
            return unpacked_hash(col(name))
        if name not in left_out:
            return col(name)
        other, derived = F.get(col(REST), F.lit(_DERIVED.index(name))), _derived(name, like, col)
        value = unpacked_hash(other) if name == "id" else F.substring(other, 2, 1 << 30).cast("string")
        value = F.when(F.length(other) > 0, value)
        return value if derived is None else F.when(other.isNull(), derived).otherwise(value)

    return {name: column(name).alias(name) for name in like.columns}


def whole(packed: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    """The rows and columns of ``like``, which were passed through ``lean``, and ``more`` columns that a join added."""
    return packed.select(*whole_columns(like).values(), *more)
