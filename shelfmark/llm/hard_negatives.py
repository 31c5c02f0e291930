"""Hard negatives by an R-tree packed by sort-tile-recursive.

A bounded sample gives the cuts of the tiles: the coordinate that spreads most is cut into slabs of equal counts, each
slab along the next one, and so on.  All rows are sorted by tile and, inside it, by one more coordinate; runs of that
order are the tree's pages, and levels of minimum bounding boxes lie above them.  Per coordinate a box bounds the inner
product with a query from both sides.  A best-first queue takes the box with the highest possible score first, and drops
for each query boxes outside its score window or strictly below its kth score so far.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import vector_blocks as vb
from shelfmark.llm.common import stored

SCALE = 256
_TILE_DIMS = 3
_SLABS = 8
_PAGE_ROWS = 128
_FANOUT = 16
_SHARD_ROWS = 8192
_BLOCK_QUERIES = 512
_EXACT = 1 << 53

_FOUND_DDL = "qid bigint, vec_id bigint, score bigint"


class Tiles:
    """Cuts of the leading coordinates, each level's cuts within the slab above; fitted on a sample."""

    def __init__(self, sample: np.ndarray):
        spread = np.argsort(-sample.var(axis=0), kind="stable") if len(sample) else np.arange(sample.shape[1])
        self.dims = spread[: min(_TILE_DIMS, len(spread))]
        self.last = spread[min(_TILE_DIMS, len(spread) - 1)]
        self.cuts: list[np.ndarray] = []
        tile = np.zeros(len(sample), np.int64)
        for level, dim in enumerate(self.dims):
            cuts = np.zeros((_SLABS**level, _SLABS - 1))
            for slab in np.unique(tile):
                values = np.sort(sample[tile == slab, dim])
                cuts[slab] = values[(np.arange(1, _SLABS) * len(values)) // _SLABS]
            self.cuts.append(cuts)
            tile = self._next(tile, sample[:, dim], cuts)

    @staticmethod
    def _next(tile: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return tile * _SLABS + (values[:, None] >= cuts[tile]).sum(axis=1)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(vectors), np.int64)
        for dim, cuts in zip(self.dims, self.cuts):
            tile = self._next(tile, vectors[:, dim], cuts)
        return tile


class Tree:
    """Pages of consecutive rows and levels of boxes, lowest first, up to one root."""

    def __init__(self, parts: list[bytes]):
        self.ids, self.uids, self.labels = (np.frombuffer(p, np.int64) for p in parts[:3])
        self.vectors = np.frombuffer(parts[3], np.dtype(parts[4].decode())).reshape(len(self.ids), -1).astype(np.float64)
        starts = np.arange(0, len(self.ids), _PAGE_ROWS)
        low, high = (f.reduceat(self.vectors, starts, axis=0) for f in (np.minimum, np.maximum))
        self.levels = [(low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), _FANOUT)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))

    def page(self, node: int) -> slice:
        return slice(node * _PAGE_ROWS, (node + 1) * _PAGE_ROWS)


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


class Queries:
    """A block: vectors with the scores and labels they ask for, and the k best rows found so far."""

    def __init__(self, parts, k: int):
        count = len(parts[0]) // 8
        self.qid, self.uid, self.label = (np.frombuffer(p, np.int64) for p in parts[:3])
        self.low, self.high = (np.frombuffer(p, np.float64) for p in parts[3:5])
        self.same = np.frombuffer(parts[5], np.bool_)
        self.vectors = np.frombuffer(parts[6], np.int64).reshape(count, -1).astype(np.float64)
        self.positive, self.negative = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        self.scores, self.ids = np.full((count, k), -np.inf), np.full((count, k), np.iinfo(np.int64).max)

    def bounds(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest score a row of each box can have inside the query's window, or minus infinity."""
        most = self.positive[rows] @ high.T + self.negative[rows] @ low.T
        least = self.positive[rows] @ low.T + self.negative[rows] @ high.T
        upper = self.high[rows, None]
        return np.where((least <= upper) & (most >= self.low[rows, None]), np.minimum(most, upper), -np.inf)

    def take(self, rows: np.ndarray, tree: Tree, page: slice) -> None:
        scores = self.vectors[rows] @ tree.vectors[page].T
        alike = tree.labels[None, page] == self.label[rows, None]
        fits = (alike == self.same[rows, None]) & (tree.uids[None, page] != self.uid[rows, None])
        fits &= (scores >= np.maximum(self.low[rows], self.scores[rows, -1])[:, None]) & (scores <= self.high[rows, None])
        some = fits.any(axis=1)
        rows, scores, fits = rows[some], scores[some], fits[some]
        if not len(rows):
            return
        ids = np.where(fits, tree.ids[None, page], np.iinfo(np.int64).max)
        all_scores = np.concatenate([self.scores[rows], np.where(fits, scores, -np.inf)], axis=1)
        all_ids = np.concatenate([self.ids[rows], ids], axis=1)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)


def best_first(trees: list[Tree], queries: Queries) -> None:
    """Visit the boxes of the trees, the highest possible score of any query first."""
    everyone = np.arange(len(queries.qid))
    queue: list[tuple] = []

    def push(tree: Tree, level: int, first: int, nodes: slice, rows: np.ndarray) -> None:
        low, high = tree.levels[level]
        keys = queries.bounds(rows, low[nodes], high[nodes])
        for at, best in enumerate(keys.max(axis=0, initial=-np.inf)):
            if best > -np.inf:
                heapq.heappush(queue, (-best, next(order), tree, level, first + at, rows, keys[:, at]))

    order = iter(range(1 << 62))
    for tree in trees:
        push(tree, len(tree.levels) - 1, 0, slice(0, 1), everyone)
    while queue:
        best, _, tree, level, node, rows, keys = heapq.heappop(queue)
        kth = queries.scores[:, -1]
        if -best < kth.min():
            break
        rows = rows[(keys >= kth[rows]) & (keys > -np.inf)]
        if not len(rows):
            continue
        if level:
            push(tree, level - 1, node * _FANOUT, slice(node * _FANOUT, (node + 1) * _FANOUT), rows)
        else:
            queries.take(rows, tree, tree.page(node))


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, label, vector) with integer components, the largest integer not above ``scale`` times each; stored.

    Rows without id or label, or whose vector is null or has a null or non-finite component, take no part.
    """
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vb.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"), whole.alias("vector"),
        ),
        "quantised",
    )


class Index:
    """The stored tree of all rows: ``rows`` carry tile and key, ``parts`` the trees in groups."""

    def __init__(self, rows: DataFrame, sample_rows: int = vb.SAMPLE_ROWS, shard_rows: int = _SHARD_ROWS):
        most = F.max(F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0)))
        count, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), most).first()
        dim = max(dim or 0, 1)
        if (most or 0) ** 2 * dim >= _EXACT:
            raise ValueError("components too large: inner products must stay below 2**53")
        tiles = Tiles(vb.matrix(vb.sampled(rows.select("uid", "vector"), sample_rows)["vector"], dim, np.float64))

        def placed(batches):
            for batch in batches:
                vectors = vb.matrix(batch.column("vector"), dim, np.int64)
                where = [pa.array(tiles.of(vectors)), pa.array(vectors[:, tiles.last])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *where], names=[*batch.schema.names, "tile", "key"])

        def packed(batches):
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            for number, run in enumerate(vb.runs(batches, shard_rows)):
                vectors = _narrow(vb.matrix(run["vector"], dim, np.int64))
                columns = [np.asarray(run[name]).astype(np.int64).tobytes() for name in ("vec_id", "uid", "label")]
                yield vb.part_batch(task, 0, [number], [[*columns, vectors.tobytes(), vectors.dtype.str.encode()]])

        ddl = "uid bigint, vec_id bigint, label bigint, vector array<bigint>, tile bigint, key bigint"
        order = ["tile", "key", "vec_id", "uid"]
        self.dim = dim
        self.rows = rows.select("uid", "vec_id", "label", "vector").mapInArrow(placed, ddl)
        dealt = self.rows.repartitionByRange(vb.group_count(rows, count, dim), *order).sortWithinPartitions(*order)
        self.parts = stored(dealt.mapInArrow(packed, vb.PART_DDL), "trees")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, score, rank): the k best rows for each of ``queries``, ties by smaller id; stored.

        ``queries`` has (qid, uid, label, vector, tile, key, low, high, same): scores lie from ``low`` to ``high``, labels
        equal the query's own where ``same`` and differ otherwise, and the row ``uid`` is none of its own results.
        """
        dim = self.dim

        def blocks(batches):
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            for number, run in enumerate(vb.runs(batches, _BLOCK_QUERIES)):
                ids = [np.asarray(run[name]).astype(np.int64).tobytes() for name in ("qid", "uid", "label")]
                ends = [np.asarray(run[name]).astype(np.float64).tobytes() for name in ("low", "high")]
                same = np.asarray(run["same"]).astype(np.bool_).tobytes()
                vectors = vb.matrix(run["vector"], dim, np.int64).tobytes()
                yield vb.part_batch(0, 1, [(task << 32) + number], [[*ids, *ends, same, vectors]])

        def search(trees, parts):
            block = Queries(parts, k)
            best_first(trees, block)
            found = block.scores > -np.inf
            qid = np.broadcast_to(block.qid[:, None], found.shape)[found]
            columns = [qid, block.ids[found], block.scores[found].astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "vec_id", "score"])

        columns = ["qid", "uid", "label", "vector", "low", "high", "same"]
        near_each_other = queries.orderBy("tile", "key", "qid").select(*columns)
        made = stored(near_each_other.mapInArrow(blocks, vb.PART_DDL), "blocks")
        found = vb.visit_groups(self.parts, made, Tree, search, _FOUND_DDL)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))
        return stored(found.withColumn("rank", rank).filter(F.col("rank") <= k), "found")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    ``rows`` come from ``quantised``; ``anchors`` is a filter of them.  An anchor's positives are the best rows of its label but
    itself; the negatives of each are the best rows of other labels with a score of at least ``least_percent`` of the
    positive's and at most that.  Rows that repeat an id are rows of their own.  Vectors of fewer components than the
    longest are padded with zeros.  Inner products are integers below 2**53; larger components are an error.
    """
    index = Index(rows)
    chosen = stored(index.rows.join(anchors.select("uid"), "uid", "left_semi"), "anchors")
    own = chosen.withColumn("qid", F.col("uid"))
    everything = [F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(True).alias("same")]
    best = index.search(own.select("*", *everything), positives)
    best = best.select(
        F.col("qid").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.monotonically_increasing_id().alias("qid"),
    )
    pairs = stored(chosen.join(best, "uid"), "positives")
    least = F.ceil(F.col("positive_score").cast("decimal(20)") * least_percent / 100).cast("double").alias("low")
    windows = pairs.select("*", least, F.col("positive_score").cast("double").alias("high"), F.lit(False).alias("same"))
    found = index.search(windows, negatives)
    told = pairs.select("qid", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    joined = told.join(found.select("qid", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "qid")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
