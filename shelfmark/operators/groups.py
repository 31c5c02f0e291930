"""Group-wise helpers that keep a very large group out of a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.session import shared_dir, task_count


def one_per_key(df: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    """One row per text key with aggregates, for the side of a join that meets rows which repeat a key very often.

    The adaptive planner splits a hot partition only when both sides of the join come straight from a shuffle, and an
    aggregate by the join key would be joined where it stands.  Appending nothing to each key hides that order from
    the planner: it shuffles this side, small by comparison, once more, and may still broadcast it.
    """
    grouped = df.groupBy(*keys).agg(*values) if values else df.select(*keys).distinct()
    return grouped.withColumns({key: F.concat(F.col(key), F.lit("")) for key in keys})


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, slices: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    A group is ranked in slices by the hash of ``spread`` first, so the final ranking meets at most ``slices * n``
    rows of it; a row among the first ``n`` of its group is also among the first ``n`` of its slice.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(slices))
    for_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    for_group = Window.partitionBy(*keys).orderBy(*order)
    sliced = df.withColumn("_slice", part).withColumn("_rank", F.row_number().over(for_slice))
    best = sliced.filter(F.col("_rank") <= n).drop("_slice", "_rank")
    return best.withColumn("_rank", F.row_number().over(for_group)).filter(F.col("_rank") <= n).drop("_rank")


def packed(df: DataFrame, size: str, tasks: int, spread: str, name: str = "task", buckets: int = 1024) -> DataFrame:
    """Add ``name``, from 0 to ``tasks - 1``, so that tasks hold about equal sums of ``size``.

    Rows go by the hash of ``spread``, unique values; sums are run up over the buckets of that hash first and then within
    each.  A row lies in the task in which its middle falls.
    """
    hashed = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    sums = hashed.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("_all")
    )
    within = Window.partitionBy("_bucket").orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0)) + F.col(size) / 2
    task = F.least(F.floor(middle * tasks / F.greatest("_all", F.lit(1))), F.lit(tasks - 1)).cast("int")
    return hashed.join(offsets, "_bucket").withColumn(name, task).drop("_bucket", "_before", "_all")


def numbered(df: DataFrame, keys: Sequence[str], start: Column, kind: DataType, name: str = "id") -> DataFrame:
    """Give rows that are unique by ``keys`` the numbers ``start + 1, start + 2, ...`` in the order of the keys' hash.

    Rows are counted per hash prefix (at most 4096 of them), the counts are summed up, and each row is ranked within
    its prefix only.
    """
    digest = F.sha2(F.concat_ws("\u0001", *keys), 256)
    hashed = df.withColumn("_digest", digest).withColumn("_prefix", F.substring("_digest", 1, 3))
    counts = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_prefix", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_digest"))
    return (
        hashed.join(offsets, "_prefix")
        .withColumn(name, (start + F.col("_before") + rank).cast(kind))
        .drop("_digest", "_prefix", "_before")
    )


def repeated(df: DataFrame, times: str, piece: int = 1_000_000) -> DataFrame:
    """Each row as often as its column ``times`` says; a large number is spread over many tasks."""
    pieces = F.sequence(F.lit(0), F.ceil(F.col(times) / piece) - 1)
    tasks = task_count(df.sparkSession)
    cut = df.filter(F.col(times) > 0).withColumn("_piece", F.explode(pieces)).repartition(tasks, *df.columns, "_piece")
    size = F.least(F.lit(piece), F.col(times) - F.col("_piece") * piece)
    return cut.select(*[c for c in df.columns if c != times], F.explode(F.sequence(F.lit(1), size)).alias("_n")).drop("_n")


def page(df: DataFrame, order: Sequence[Column], start: int, length: int, in_one_task: int = 100_000) -> DataFrame:
    """Rows ``start`` to ``start + length`` in a total order.

    Near the front these come from a top-k.  Farther on, that would bring all earlier rows to one task; the sorted
    rows are then written to the shared folder once, counted per partition, and only the page is picked.
    """
    if start + length <= in_one_task:
        return df.orderBy(*order).offset(start).limit(length)
    place = F.monotonically_increasing_id()
    path = shared_dir(df.sparkSession, "page")
    df.orderBy(*order).withColumn("_place", place).write.parquet(path)
    split = F.shiftrightunsigned("_place", 33)
    ranked = df.sparkSession.read.parquet(path).withColumn("_part", split)
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(offsets, "_part").filter((rank >= start) & (rank < start + length)).select(*df.columns)


def joined_text(
    df: DataFrame, keys: Sequence[str], value: str, name: str, sep: str = ", ", per_row: int | None = None
) -> DataFrame:
    """The distinct values of each group, sorted and joined to one text: (keys, part, name).

    Each group is one row with ``part`` 0.  Where a caller gives ``per_row``, a group with more distinct values is
    spread over several rows, ``part`` 0, 1, ..., each with its own share of the values; none is dropped.
    """
    values = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    text = F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name)
    if per_row is None:
        return values.groupBy(*keys).agg(text).select(*keys, F.lit(0).alias("part"), name)
    sizes = one_per_key(values, keys, F.ceil(F.count(F.lit(1)) / per_row).alias("_parts"))
    share = F.pmod(F.xxhash64(value), F.col("_parts")).cast("int")
    return (
        values.join(sizes, list(keys))
        .groupBy(*keys, share.alias("part"))
        .agg(text)
    )
