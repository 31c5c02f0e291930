"""What several corpus operators need: tables, stored intermediate results, batches of bounded size, prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import remove_dir, shared_dir

# Letters A-Z to lower case and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []  # by ``stored``, in order


def stored(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read from there, with the session's codec unless one is given.

    A result that several later steps read is computed once this way, and a lost executor does not take it along.  The
    rows stay until the caller is through with what was made of them; see ``alone``.  The shuffles on the way to them
    have no other reader, so their files go as soon as the rows are written, not when the driver's garbage is collected.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    cleans = spark.conf.get(_CLEANS, "false")
    spark.conf.set(_CLEANS, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANS, cleans)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, build: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """The result of ``build`` stored, and all that was stored on the way to it removed."""
    before = len(_written)
    made = stored(build(), purpose)
    for path in _written[before:-1]:
        remove_dir(spark, path)
    del _written[before:-1]
    return made


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts in ``column`` take up about ``limit`` bytes; one longer text is a part."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def all_slices(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, limit)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if value is None else value for value in texts.cast(pa.binary()).to_pylist()]


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the same ``keys``.

    Rows are ordered by ``bucket`` first and by ``order`` within it.  Sums per bucket are added up over the short list
    of buckets, and rows only within their bucket, so a key that holds most rows is spread over its buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        inner.join(offsets, [*keys, bucket])
        .withColumn(name, (F.col("_before") + F.col("_inner")).cast("bigint"))
        .drop("_before", "_inner")
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
