"""Near-duplicate documents by circulant MinHash.

Two permutations of the hash values give all signature coordinates: the first scatters a document's shingles, the
second, shifted circularly by k, orders them for coordinate k, and the smallest value is kept.  Bands of coordinates
propose documents, and the full shingle sets confirm them.

Documents with equal sets are one node from the start, so copies never meet in pairs.  Nodes that share a band go to one
task, which compares them twice: sketches of the signatures, one byte a coordinate, name the nodes that have a
promising partner there and in no earlier band, and only their full sets are sent and intersected.  Both steps give at
most one row per node and band, however many of its nodes are similar without being linked.  A band of very many nodes
or bytes does not go to one task: its nodes are compared with leaders of the band first, what that links is merged, and
nodes still apart are compared in joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import all_slices, as_bytes, stored
from shelfmark.llm.components import connected, lowered
from shelfmark.operators.groups import one_per_key

SHINGLE_WORDS = 5
ROWS = 6  # coordinates of a band
MISSED = 1e-6  # chance that the bands miss a pair exactly at the threshold
_SLICE_BYTES = 2 << 20
_RUN = 1 << 15
_REMEMBERED = 300_000
_PAIRS_PER_NODE = 20
_LEADER_ROUNDS = 6

_SIGNED_DDL = "doc_id bigint, digest binary, n bigint, set_key string, bands array<bigint>"
_SETS_DDL = "set_key string, n bigint, shingles binary, sketch binary, bands array<bigint>"
_BAND_NODES = 4096  # nodes and bytes of sets of a band that one task compares
_BAND_BYTES = 64 << 20


def bands_for(percent: int, rows: int = ROWS, missed: float = MISSED) -> int:
    """Bands needed to miss a pair at the threshold with at most the given chance."""
    return math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** rows))


@lru_cache(maxsize=1)
def _word_hashes() -> dict[bytes, int]:
    return {}


def _hashed(words: list[bytes]) -> np.ndarray:
    known = _word_hashes()
    if len(known) > _REMEMBERED:
        known.clear()
    found = list(map(known.get, words))
    if None in found:
        for word in {w for w in words if w not in known}:
            known[word] = xxhash.xxh64_intdigest(word)
        found = list(map(known.__getitem__, words))
    return np.array(found, np.uint64)


def _scattered(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of fewer words the whole sequence is one.

    A-Z are lower-cased; words are separated by the six ASCII white-space characters.  No words, empty set.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = _hashed(words)
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    mixed = np.full(count, min(len(words), SHINGLE_WORDS), np.uint64)
    for at in range(min(len(words), SHINGLE_WORDS)):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + count]
    mixed = np.sort(_scattered(mixed))
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def _ordered(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit values, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of coordinates for each non-empty set."""
    out = np.empty((len(sets), coordinates), np.uint32)
    low = 0
    while low < len(sets):
        high, size = low + 1, len(sets[low])
        while high < len(sets) and size + len(sets[high]) <= _RUN:
            size += len(sets[high])
            high += 1
        starts = np.cumsum([0, *(len(s) for s in sets[low : high - 1])])
        values = np.concatenate(sets[low:high])
        # The first permutation: values are hashes already, so their upper half multiplied by an odd number.
        first = (values >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1)
        for k in range(coordinates):
            out[low:high, k] = np.minimum.reduceat(_ordered(first + np.uint32(k)), starts)
        low = high
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different for equal coordinates of different bands."""
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for row in range(ROWS):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, row : bands * ROWS : ROWS]
        keys = _scattered(keys)
    return keys.view(np.int64)


def _key(values: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None


def _signed(docs: DataFrame, bands: int) -> DataFrame:
    def sign(batches):
        for part in all_slices(batches, 1, _SLICE_BYTES):
            texts = as_bytes(part.column(1))
            sets = [shingle_set(t) for t in texts]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, bands * ROWS), bands).tolist())
            columns = [
                part.column(0), pa.array([md5(t).digest() for t in texts], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_key, sets), pa.string()),
                pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "set_key", "bands"])

    return stored(docs.select("doc_id", "text").mapInArrow(sign, _SIGNED_DDL), "signatures")


def _sets(docs: DataFrame, bands: int) -> DataFrame:
    def build(batches):
        for part in all_slices(batches, 1, _SLICE_BYTES):
            sets = [s for s in (shingle_set(t) for t in as_bytes(part.column(1))) if len(s)]
            signed = signatures(sets, bands * ROWS)
            columns = [
                pa.array(map(_key, sets), pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([row.tobytes() for row in signed.astype(np.uint8)], pa.binary()),
                pa.array(band_keys(signed, bands).tolist(), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["set_key", "n", "shingles", "sketch", "bands"])

    return docs.select("doc_id", "text").mapInArrow(build, _SETS_DDL)


def least_agreement(percent: int, coordinates: int, missed: float = MISSED) -> int:
    """Coordinates in which a pair at the threshold agrees at least, but for the given chance."""
    share, below = percent / 100, 0.0
    for agreed in range(coordinates + 1):
        below += math.comb(coordinates, agreed) * share**agreed * (1 - share) ** (coordinates - agreed)
        if below > missed:
            return agreed
    return coordinates


class _Band:
    """Rows of whole bands, sorted by band: which pairs of a band are worth an intersection."""

    def __init__(self, table: pa.Table, percent: int):
        column = lambda name: table[name].combine_chunks()
        self.bucket, self.nid, self.n = (np.asarray(column(name)) for name in ("bucket", "nid", "n"))
        self.bands = np.asarray(column("bands").flatten()).reshape(len(self.nid), -1)
        self.sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(self.nid), -1)
        self.percent, self.least = percent, least_agreement(percent, self.sketch.shape[1])

    def promising(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs whose sizes fit, whose sketches agree enough, and that share no earlier band."""
        gap = 1
        while True:
            left = np.flatnonzero(self.bucket[:-gap] == self.bucket[gap:]) if gap < len(self.bucket) else np.empty(0, np.int64)
            if not len(left):
                return
            small, large = np.minimum(self.n[left], self.n[left + gap]), np.maximum(self.n[left], self.n[left + gap])
            left = left[100 * small >= self.percent * large]
            for at in range(0, len(left), 8192):
                some = left[at : at + 8192]
                some = some[(self.sketch[some] == self.sketch[some + gap]).sum(axis=1) >= self.least]
                first = (self.bands[some] == self.bands[some + gap]).argmax(axis=1)
                some = some[self.bands[some, first] == self.bucket[some]]
                yield some, some + gap
            gap += 1


class Groups:
    """What links join among the nodes a task has at hand."""

    def __init__(self, nid: np.ndarray):
        self.nid, self.root = nid, list(range(len(nid)))

    def top(self, at: int) -> int:
        while self.root[at] != at:
            self.root[at] = self.root[self.root[at]]
            at = self.root[at]
        return at

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.top(i), self.top(j)), key=lambda at: self.nid[at])
        self.root[b] = a

    def links(self) -> pa.RecordBatch:
        """(a, b): each joined node b and the smallest node a of its group."""
        tops = np.array([self.top(at) for at in range(len(self.root))], np.int64)
        joined = tops != np.arange(len(tops))
        return pa.RecordBatch.from_arrays([pa.array(self.nid[tops[joined]]), pa.array(self.nid[joined])], names=["a", "b"])


def whole_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole bands: the last band of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = np.asarray(batch.column(0))
        last = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0
        if held and (last or bucket[0] != held[-1].column(0)[0].as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _in_bands(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the nodes of each band that join its linked nodes, found by the task that has the band."""

    def point_out(batches):
        for table in whole_bands(batches):
            rows = _Band(table, percent)
            found = np.zeros(len(rows.nid), bool)
            for left, right in rows.promising():
                found[left] = found[right] = True
            yield pa.RecordBatch.from_arrays([pa.array(rows.bucket[found]), pa.array(rows.nid[found])], names=["bucket", "nid"])

    def link(batches):
        for table in whole_bands(batches):
            rows, texts = _Band(table, percent), table["shingles"].combine_chunks()
            groups = Groups(rows.nid)
            for left, right in rows.promising():
                for i, j in zip(left.tolist(), right.tolist()):
                    if groups.top(i) != groups.top(j):
                        x, y = (np.frombuffer(texts[at].as_buffer(), np.uint64) for at in (i, j))
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            groups.join(i, j)
            yield groups.links()

    about = sets.select("nid", "n", "sketch", "bands")
    near = buckets.select("bucket", "nid").join(about, "nid").select("bucket", "nid", "n", "sketch", "bands")
    wanted = near.repartition("bucket").sortWithinPartitions("bucket", "nid").mapInArrow(point_out, "bucket bigint, nid bigint")
    full = stored(wanted, "promising").join(sets, "nid").select("bucket", "nid", "n", "sketch", "bands", "shingles")
    return full.repartition("bucket").sortWithinPartitions("bucket", "nid").mapInArrow(link, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            found.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(found, pa.bool_())

    of_a = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("_left"))
    of_b = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("_right"))
    joined = pairs.join(of_a, "a").join(of_b, "b")
    return stored(joined.filter(alike("_left", "_right")).select("a", "b"), "links")


def _fits(percent: int):
    """A pair can only reach the threshold when the smaller set is large enough by itself."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _pair(left, right):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def linked(buckets: DataFrame, confirmed: Callable[[DataFrame], DataFrame], fits: Column, known: DataFrame | None = None) -> DataFrame:
    """(nid, root) of what belongs together among the nodes of ``buckets`` (bucket, nid, n).

    ``known`` are links (a, b) found by tasks that have whole bands, at most one per band and larger node.

    ``fits`` says of sizes n and m whether a pair is worth a test, and ``confirmed`` keeps the pairs (a, b) that are
    links, stored.
    """
    spark = buckets.sparkSession
    links, tested = stored(lowered(known), "links") if known is not None else None, None
    roots = connected(links) if links is not None else spark.createDataFrame([], "nid bigint, root bigint")
    for turn in range(_LEADER_ROUNDS + 1):
        rooted = buckets.join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
        spread = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
        parted = spread.filter(F.col("_low") != F.col("_high")).select("bucket")
        open_ = stored(rooted.join(parted, "bucket"), "buckets")
        counts = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"))
        sizes = counts.groupBy("bucket").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "root")).alias("_main"))
        sizes = sizes.select("bucket", "_all", F.col("_main.root").alias("_root"), F.col("_main._n").alias("_n"))
        work = sizes.agg(
            F.sum((F.col("_all") - F.col("_n")) * F.col("_all").cast("double")), F.sum("_all")
        ).first()
        if not work[1]:
            break
        last = turn == _LEADER_ROUNDS or work[0] <= _PAIRS_PER_NODE * work[1]
        if last:  # few enough left: each node outside the main component of its band meets all others of the band
            apart = open_.join(sizes.select("bucket", "_root"), "bucket").filter(F.col("root") != F.col("_root"))
            others = open_.select("bucket", F.col("nid").alias("_nid"), F.col("n").alias("m"), F.col("root").alias("_other"))
            met = apart.join(others, "bucket").filter((F.col("root") != F.col("_other")) & fits)
        else:
            rank = F.xxhash64(F.lit(turn), "nid")
            leaders = open_.groupBy("bucket").agg(F.min_by(F.struct("nid", "n", "root"), rank).alias("_l"))
            leaders = leaders.select(
                "bucket", F.col("_l.nid").alias("_nid"), F.col("_l.n").alias("m"), F.col("_l.root").alias("_other")
            )
            met = open_.join(leaders, "bucket").filter((F.col("root") != F.col("_other")) & fits)
        pairs = met.select(*_pair(F.col("nid"), F.col("_nid"))).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = confirmed(pairs)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = connected(links)
        if last:
            break
    return roots


def near_duplicates(docs: DataFrame, percent: int = 80, band_nodes: int = _BAND_NODES) -> DataFrame:
    """One row per document row: (doc_id, n_shingles, component_id, kept, digest, group_id).

    Documents are linked when their sets of five-word shingles have ``100 * common >= percent * union``.
    ``component_id`` is the smallest id that links lead to, the document's own included, and ``kept`` says that it is
    the document's own.  A text without words has the empty set and no link.  A document without an id takes part in
    no link: its component is null and it is kept.  Rows that repeat an id and a text are alike in the result.
    ``digest`` is the MD5 of the row's text; ``group_id`` tells groups apart where an id repeats with other texts, so that two
    groups have the same smallest id, and is null for a row without words or id.  Bands of
    more than ``band_nodes`` different sets are compared in joins instead of by one task.

    The bands miss a pair at the threshold with a chance of one in a million, the sketches with another one, and pairs
    above the threshold more rarely.
    """
    bands = bands_for(percent)
    signed = _signed(docs, bands)
    usable = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    nodes, salt = None, 0
    while nodes is None or not nodes.groupBy("nid").count().filter("count > 1").isEmpty():
        nodes, salt = stored(classes.withColumn("nid", F.xxhash64(F.lit(salt), "set_key")), "nodes"), salt + 1

    keyed = usable.select("set_key", F.explode("bands").alias("bucket"))
    nid = F.xxhash64(F.lit(salt - 1), "set_key")
    # Equal sets have equal bands: one row per set and band, then the bands that several sets share.
    rows = keyed.select(nid.alias("nid"), "bucket").distinct()
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    buckets = rows.join(shared, "bucket").join(nodes.select("nid", "n"), "nid").select("bucket", "nid", "n")
    buckets = stored(buckets, "buckets")

    wanted = buckets.select("nid").distinct().join(nodes.select("nid", "rep", "set_key"), "nid")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = _sets(texts, bands).join(wanted.select("set_key", "nid"), "set_key").dropDuplicates(["nid"]).drop("set_key")
    sets = stored(sets, "sets")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), (8 * F.sum("n")).alias("_bytes"))
    in_joins = stored(sizes.filter((F.col("_n") > band_nodes) | (F.col("_bytes") > _BAND_BYTES)).select("bucket"), "large")
    links = _in_bands(buckets.join(in_joins, "bucket", "left_anti"), sets, percent)
    large = buckets.join(in_joins, "bucket")
    roots = linked(large, lambda pairs: _confirmed(pairs, sets, percent), _fits(percent), links)

    rooted = nodes.join(roots, "nid").select("set_key", "rep", "root")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = rooted.join(least, "root").select("set_key", "component_id", "root")
    lowest = nodes.select("set_key", "rep", "nid").join(moved, "set_key", "left")
    lowest = one_per_key(
        lowest, ["set_key"], F.min(F.coalesce("component_id", "rep")).alias("component_id"), F.min(F.coalesce("root", "nid")).alias("group_id")
    )
    members = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_key", "digest")
    found = members.join(lowest, "set_key", "left")
    named = F.col("doc_id").isNotNull()
    component = F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return found.select("doc_id", "n_shingles", component, kept, "digest", F.when(named, F.col("group_id")).alias("group_id"))
