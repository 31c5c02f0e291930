"""Vectors searched in blocks: a stored index in groups of bounded size, and blocks of queries that visit every group.

An index row is a part of the index, a query row a block of queries; both carry numpy arrays as bytes.  Blocks are
copied to every group and sorted behind its index rows, so a task holds one group and one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import task_count

PART_DDL = "g int, kind int, id bigint, parts array<binary>"
_PART_NAMES = ["g", "kind", "id", "parts"]
_PART_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary())]
SAMPLE_ROWS = 20_000  # rows that an index is fitted on
_GROUP_BYTES = 64 << 20
_LEAST_GROUP = 1024


def usable(vector: Column) -> Column:
    """Not null, and neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def matrix(vectors: pa.Array, dim: int, dtype) -> np.ndarray:
    """A row per vector; vectors of fewer components than ``dim`` are padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = np.asarray(vectors.flatten()).astype(dtype)
    lengths = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(lengths), dim), dtype)
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


def sampled(rows: DataFrame, limit: int = SAMPLE_ROWS) -> pa.Table:
    """At most ``limit`` rows, those with the smallest hash of their ``uid``: what an index is fitted on."""
    return rows.orderBy(F.xxhash64("uid"), "uid").limit(limit).toArrow()


def group_rows(rows: int, dim: int, tasks: int) -> int:
    """Rows of an index group: a share for each of a few tasks per core, within a fixed number of bytes."""
    return max(_LEAST_GROUP, min(math.ceil(rows / (2 * tasks)), _GROUP_BYTES // (8 * dim)))


def group_count(rows: DataFrame, count: int, dim: int) -> int:
    return max(1, math.ceil(count / group_rows(count, dim, task_count(rows.sparkSession))))


def part_batch(g: int, kind: int, ids: list[int], parts: list[list[bytes]]) -> pa.RecordBatch:
    columns = [[g] * len(ids), [kind] * len(ids), ids, parts]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_TYPES)], names=_PART_NAMES)


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in runs of ``size``; the last one may be shorter."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == size:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def visit_groups(index: DataFrame, blocks: DataFrame, load: Callable, search: Callable, ddl: str) -> DataFrame:
    """``search(loaded parts of a group, parts of a block)`` for every group and block, giving record batches.

    ``index`` and ``blocks`` are stored rows of ``PART_DDL``; ``load`` turns the parts of one index row into what the
    search takes.  Every block is copied once for each group, which holds many blocks' worth of rows.
    """
    groups = index.agg(F.coalesce(F.max("g"), F.lit(-1))).first()[0] + 1
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(max(groups - 1, 0))))
    visits = blocks.select(everywhere.alias("g"), "kind", "id", "parts")
    both = index.unionByName(visits).repartition(max(groups, 1), "g").sortWithinPartitions("g", "kind", "id")

    def run(batches):
        current, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                g, kind = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                parts = [value.as_buffer() for value in batch.column(3)[at].values]
                if g != current:
                    current, held = g, []
                if kind == 0:
                    held.append(load([bytes(p) for p in parts]))
                elif held:
                    yield search(held, parts)

    return both.mapInArrow(run, ddl)
