"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample turn a vector into signs, several rotations giving one code of ``BITS`` bits.
Each code is cut into substrings, and every group of rows has a table of each substring: its distinct values, and the
rows of each value.  If two codes differ in at most m * (s + 1) - 1 bits, one of their m substrings differs in at most
s, so probing all substring values within s bits retrieves every code within that radius.  Distances of the vectors
themselves then rank what was retrieved.

The radius follows from the kth distance found so far.  That distance bounds the angle of any nearer vector, an angle
says how many bits differ on average, and the sample says how far the number strays from it; s grows until the radius
is covered.  A search far from everything thus ends by probing all values, which compares with every row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import vector_blocks as vb
from shelfmark.llm.common import stored

BITS = 256
SUBSTRING = 16
STRAY = 0.99  # share of the sample's neighbours whose differing bits the radius covers
_TURNS = 15
_PROBES = 200
_SHARD_ROWS = 16_384
_BLOCK_QUERIES = 256
_FOUND_DDL = "qid bigint, vec_id bigint, score double"


def learned_rotation(vectors: np.ndarray, turns: int, seed: int) -> np.ndarray:
    """An orthogonal matrix that brings the vectors close to their signs: iterative quantisation from a random start."""
    dim = vectors.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    for _ in range(turns if len(vectors) else 0):
        left, _, right = np.linalg.svd(vectors.T @ np.where(vectors @ rotation >= 0, 1.0, -1.0))
        rotation = left @ right
    return rotation


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def angle_within(distance: np.ndarray, norm: np.ndarray, low: float, high: float) -> np.ndarray:
    """The widest angle between a vector of this norm and one within the distance whose norm is from ``low`` to ``high``."""
    other = np.clip(np.sqrt(np.maximum(norm**2 - distance**2, 0)), low, high)
    return np.arccos(np.clip((norm**2 + other**2 - distance**2) / (2 * norm * other), -1, 1))


class Codes:
    """Rotations and the radius rule, both fitted on a sample of vectors without zero ones."""

    def __init__(self, sample: np.ndarray, low: float, high: float, k: int):
        dim = sample.shape[1]
        self.low, self.high = low, high
        unit = _unit(sample) if len(sample) else sample
        count = math.ceil(BITS / dim)
        self.planes = np.concatenate([learned_rotation(unit, _TURNS, seed) for seed in range(count)], axis=1)[:, :BITS]
        strays = np.zeros(0)
        if len(unit) > k:
            codes = self.of(sample)
            for at in range(0, len(unit), max(1, len(unit) // _PROBES)):
                near = np.argsort(-(unit @ unit[at]), kind="stable")[: k + 1]
                angle = np.arccos(np.clip(unit[near] @ unit[at], -1, 1))
                differ = np.bitwise_count(codes[near] ^ codes[at]).sum(axis=1)
                strays = np.append(strays, (differ - self._mean(angle)) / self._spread(angle))
        self.stray = max(1.0, float(np.quantile(strays, STRAY))) if len(strays) else 3.0

    @staticmethod
    def _mean(angle: np.ndarray) -> np.ndarray:
        return BITS * angle / math.pi

    @staticmethod
    def _spread(angle: np.ndarray) -> np.ndarray:
        share = np.clip(angle / math.pi, 1 / BITS, 1 - 1 / BITS)
        return np.sqrt(BITS * share * (1 - share))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings per vector."""
        return np.packbits(vectors @ self.planes >= 0, axis=1).view(np.uint16)

    def radius(self, distance: float, norm: float) -> int:
        """Bits in which a vector within the distance may differ."""
        if not math.isfinite(distance):
            return BITS
        angle = angle_within(np.float64(distance), np.float64(norm), self.low, self.high)
        return min(BITS, math.ceil(self._mean(angle) + self.stray * self._spread(angle)))


class Shard:
    """Rows of one part of the index with a table per substring: distinct values and the rows of each."""

    def __init__(self, parts: list[bytes]):
        self.ids, self.uids = (np.frombuffer(p, np.int64) for p in parts[:2])
        self.vectors = np.frombuffer(parts[2], np.dtype(parts[3].decode())).reshape(len(self.ids), -1).astype(np.float64)
        self.codes = np.frombuffer(parts[4], np.uint16).reshape(len(self.ids), -1)
        # All substrings' tables behind one another; ``sizes`` says how many values each has.
        self.sizes, self.values = np.frombuffer(parts[5], np.int64), np.frombuffer(parts[6], np.uint16)
        self.low, self.rows = np.frombuffer(parts[7], np.int64), np.frombuffer(parts[8], np.int32)
        self.count = np.diff(np.append(self.low, len(self.rows)))

    @staticmethod
    def parts(ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> list[bytes]:
        sizes, values, starts, rows = [], [], [], []
        for at, column in enumerate(codes.T):
            order = np.argsort(column, kind="stable").astype(np.int32)
            value, start = np.unique(column[order], return_index=True)
            sizes.append(len(value))
            values.append(value)
            starts.append(start + at * len(ids))
            rows.append(order)
        return [
            ids.tobytes(), uids.tobytes(), vectors.tobytes(), vectors.dtype.str.encode(), codes.tobytes(),
            np.array(sizes, np.int64).tobytes(), *(np.concatenate(x).tobytes() for x in (values, starts, rows)),
        ]

    def apart(self, code: np.ndarray) -> np.ndarray:
        """Bits in which each substring value differs from the code's substring."""
        return np.bitwise_count(self.values ^ np.repeat(code, self.sizes))

    def holding(self, chosen: np.ndarray) -> np.ndarray:
        """Which rows have one of the chosen values."""
        low, count = self.low[chosen], self.count[chosen]
        begin = np.cumsum(count) - count
        found = np.zeros(len(self.ids), bool)
        found[self.rows[np.repeat(low - begin, count) + np.arange(count.sum())]] = True
        return found


class Best:
    """The k nearest rows of one query so far."""

    def __init__(self, k: int):
        self.scores, self.ids = np.full(k, np.inf), np.full(k, np.iinfo(np.int64).max)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, scores))[: len(self.scores)]
        self.scores, self.ids = scores[best], ids[best]


def probe(shard: Shard, codes: Codes, vector: np.ndarray, code: np.ndarray, uid: int, best: Best) -> int:
    """Add what the shard has within the radius, growing the substring radius until it is covered; rows compared.

    With k rows known from earlier shards the first step covers their radius at once.
    """
    norm = float(np.linalg.norm(vector))
    apart, substrings = shard.apart(code), len(code)
    seen = shard.uids == uid
    waiting, bits = np.zeros(0, np.int64), np.zeros(0, np.int64)
    compared = 0
    known = codes.radius(best.scores[-1], norm) if math.isfinite(best.scores[-1]) else 0
    for step in range(known // substrings, SUBSTRING + 1):
        covered = substrings * (step + 1) - 1
        probed = shard.holding(np.flatnonzero(apart <= step))
        found = np.flatnonzero(probed & ~seen)
        seen |= probed
        waiting = np.append(waiting, found)
        bits = np.append(bits, np.bitwise_count(shard.codes[found] ^ code).sum(axis=1, dtype=np.int64))
        within = bits <= min(covered, codes.radius(best.scores[-1], norm))
        rows, waiting, bits = waiting[within], waiting[~within], bits[~within]
        if len(rows):
            compared += len(rows)
            gap = shard.vectors[rows] - vector
            best.take(np.sqrt(np.einsum("ij,ij->i", gap, gap)), shard.ids[rows])
        if covered >= codes.radius(best.scores[-1], norm):
            break
    return compared


def nearest_neighbours(
    embeddings: DataFrame, queries: Column, k: int = 10, sample_rows: int = vb.SAMPLE_ROWS, shard_rows: int = _SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows found for each row of ``queries``, a condition.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id.  A query is none of its own
    results; another row that repeats its id may be.  Rows without an id take no part, nor do vectors that are null,
    zero, or hold a null or non-finite component; vectors of fewer components than the longest are padded with zeros.
    Every row is indexed; rotations and the radius rule are fitted on at most ``sample_rows`` rows.
    """
    vector = F.col("embedding")
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & vb.usable(vector)).select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"),
        vector.alias("vector"), F.sqrt(square).alias("norm"), F.coalesce(queries, F.lit(False)).alias("asked"),
    )
    rows = stored(rows.filter("norm > 0"), "vectors")
    count, dim, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.min("norm"), F.max("norm")).first()
    dim = dim or 1
    codes = Codes(vb.matrix(vb.sampled(rows.select("uid", "vector"), sample_rows)["vector"], dim, np.float64), low or 1.0, high or 1.0, k)
    kept_as = np.float32 if rows.schema["vector"].dataType.elementType.typeName() == "float" else np.float64

    def indexed(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, run in enumerate(vb.runs(batches, shard_rows)):
            vectors = vb.matrix(run["vector"], dim, kept_as)
            ids, uids = (np.asarray(run[name]).astype(np.int64) for name in ("vec_id", "uid"))
            yield vb.part_batch(task, 0, [number], [Shard.parts(ids, uids, vectors, codes.of(vectors.astype(np.float64)))])

    def blocks(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, run in enumerate(vb.runs(batches, _BLOCK_QUERIES)):
            vectors = vb.matrix(run["vector"], dim, np.float64)
            uids = np.asarray(run["uid"]).astype(np.int64)
            yield vb.part_batch(0, 1, [(task << 32) + number], [[uids.tobytes(), vectors.tobytes(), codes.of(vectors).tobytes()]])

    def search(shards, parts):
        uids = np.frombuffer(parts[0], np.int64)
        vectors = np.frombuffer(parts[1], np.float64).reshape(len(uids), -1)
        asked = np.frombuffer(parts[2], np.uint16).reshape(len(uids), -1)
        found: list[list] = [[], [], []]
        for uid, vector, code in zip(uids.tolist(), vectors, asked):
            best = Best(k)
            for shard in shards:
                probe(shard, codes, vector, code, uid, best)
            real = best.scores < np.inf
            for column, values in zip(found, (np.full(real.sum(), uid), best.ids[real], best.scores[real])):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["qid", "vec_id", "score"])

    dealt = rows.repartition(vb.group_count(rows, count, dim), "uid")
    index = stored(dealt.select("uid", "vec_id", "vector").mapInArrow(indexed, vb.PART_DDL), "codes")
    chosen = rows.filter("asked").select("uid", "vec_id", "vector")
    found = vb.visit_groups(index, stored(chosen.mapInArrow(blocks, vb.PART_DDL), "blocks"), Shard, search, _FOUND_DDL)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id")).cast("int")
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = chosen.select(F.col("uid").alias("qid"), F.col("vec_id").alias("query_id"))
    return best.join(named, "qid").select("query_id", "rank", "vec_id", "score")
