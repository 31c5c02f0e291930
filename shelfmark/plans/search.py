"""Search by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.ordering import ascending, descending
from shelfmark.functions.text import contains_pattern
from shelfmark.operators.groups import page
from shelfmark.settings import SEARCH_ROWS

_KEYS = ["f_name_lc", "f_name", "f_parent", "sha256", "label_v"]
_COLUMNS = {0: "f_name", 1: "f_parent", 2: "sha256", 3: "label_v"}


def search_names(cards: DataFrame, text: str, limit: int = SEARCH_ROWS, most: int = SEARCH_ROWS) -> DataFrame:
    """Distinct names that contain the text; a space in it stands for anything.

    A caller's ``limit`` counts up to ``most`` rows, which is 100 unless another bound is given.
    """
    found = cards.filter(F.lower("f_name_lc").like(contains_pattern(text)))
    return found.select("f_name").distinct().orderBy("f_name").limit(min(limit, most))


def search_page(
    cards: DataFrame, devices: DataFrame, draw: int, start: int, length: int,
    search: str = "", column: int | None = None, direction: str = "",
) -> DataFrame:
    """One page of a search as one row: (draw, recordsTotal, recordsFiltered, data, error).

    Rows are the distinct (lower-case name, name, folder, content, device label).  The page is cut in that order and
    sorted by the chosen column afterwards.
    """
    labels = devices.select(F.col("uid").alias("device_uid"), "label_v")
    files = cards.select("f_name_lc", "f_name", "f_parent", "sha256", "device_uid")
    rows = files.join(labels, "device_uid", "left").select(*_KEYS).distinct()
    matching = rows.filter(F.col("f_name_lc").like(contains_pattern(search)))
    cut = page(matching, [ascending(key) for key in _KEYS], start, length)

    chosen = _COLUMNS.get(column, "f_name") if direction in ("asc", "desc") else "f_name"
    order = descending(chosen) if direction == "desc" and column in _COLUMNS else ascending(chosen)
    # The page has at most ``length`` rows by now, so ranking it in one task is bounded.
    place = F.row_number().over(Window.orderBy(order, *map(ascending, _KEYS)))
    entry = F.struct(
        place.alias("place"),
        F.struct(
            F.col("f_name").alias("name"), F.col("f_parent").alias("path"),
            F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("label_v", F.lit("")).alias("device"),
        ).alias("entry"),
    )
    none = F.lit(None)
    parts = (
        cut.select(entry.alias("e"), none.cast("bigint").alias("total"), none.cast("bigint").alias("filtered"))
        .unionByName(rows.agg(F.count(F.lit(1)).alias("total")), allowMissingColumns=True)
        .unionByName(matching.agg(F.count(F.lit(1)).alias("filtered")), allowMissingColumns=True)
    )
    entries = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"])
    return parts.agg(
        F.lit(draw).alias("draw"), F.max("total").alias("recordsTotal"), F.max("filtered").alias("recordsFiltered"),
        entries.alias("data"), F.lit("").alias("error"),
    )
