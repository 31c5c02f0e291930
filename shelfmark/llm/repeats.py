"""Repeated passages: every byte that a string of 200 bytes covers which also starts somewhere else.

Sorting the suffixes at all positions would ship 200 bytes for each byte of text, so the suffix order is sparse: only
suffixes at anchors are kept.  The anchor of a 200-byte string is the place of the smallest hash among the 32-byte
strings in it, leftmost if there are several; equal strings have it at the same place, so comparing strings that share
an anchor's leading 32 bytes loses nothing.  Anchors whose lead occurs once are dropped.  Of the others, those with
equal surroundings form a class, decided by its count.  Where one lead has several classes, one context for each is
range-partitioned by the lead with Spark's sampled splitters and sorted; equal leads never lie across a boundary.
Leads with very many classes are not gathered: their strings are counted by hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.session import task_count

LENGTH = 200
LEAD = 32
_WINDOW = LENGTH - LEAD + 1
_RUN_BYTES = 1 << 19
_GATHERED = 2000  # classes of one lead that one task compares
_BLOCK = 8
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)


class _Hasher:
    """Hashes of all ranges of one run of bytes, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        count = len(data) + 1
        terms = _BYTES[data] * _powers(_BASE, count)[:-1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(pow(_BASE, -1, 2**64), count)

    def ranges(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, width: int) -> np.ndarray:
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Best value of each window, by windows of doubling width."""
    reach = 1
    while reach * 2 <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return best(values[:-rest], values[rest:]) if rest else values


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (row, offset, bytes), about half a megabyte each; a longer text comes in pieces that share 199 bytes."""
    run, size = [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(0, len(text) - LENGTH + 1), _RUN_BYTES):
            part = text[start : start + _RUN_BYTES + LENGTH - 1]
            if run and size + len(part) > _RUN_BYTES:
                yield run
                run, size = [], 0
            run.append((row, start, part))
            size += len(part)
    if run:
        yield run


def anchors(run: list[tuple[int, int, bytes]]):
    """Of all 200-byte strings of a run: (piece, place, first and last string start, hash of the lead, of the whole)."""
    sizes = np.array([len(part) for _, _, part in run])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(part for _, _, part in run), np.uint8)
    hasher = _Hasher(data)
    hashes = hasher.all(LEAD)
    for end in ends[:-1]:  # leads across two pieces
        hashes[end - LEAD + 1 : end] = _NONE
    least = _slide(hashes, _WINDOW, np.minimum)
    for end in ends[:-1]:  # strings across two pieces
        least[end - LENGTH + 1 : end] = 0
    padding = np.zeros(_WINDOW - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([padding, least, padding]), _WINDOW, np.maximum) == hashes)
    # Chosen places by value and then place; runs of string starts with one least value find theirs among them.
    values, codes = np.unique(hashes[chosen], return_inverse=True)
    span = len(data) + LENGTH
    order = np.argsort(codes * span + chosen)
    places, keys = chosen[order], (codes * span + chosen)[order]
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    valid = least[first] != 0
    first, last = first[valid], last[valid]
    code = np.searchsorted(values, least[first])
    low, high = np.searchsorted(keys, code * span + first), np.searchsorted(keys, code * span + last + _WINDOW)
    counts = high - low
    of = np.repeat(np.arange(len(first)), counts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    place = places[at]
    same = np.concatenate([[False], codes[order][1:] == codes[order][:-1]])
    before = np.where(same, np.concatenate([[0], places[:-1]]), -1)[at]
    starts = np.maximum(np.maximum(first[of], place - _WINDOW + 1), before + 1)
    stops = np.minimum(last[of], place)
    good = starts <= stops
    place, starts, stops = place[good], starts[good], stops[good]
    piece = np.searchsorted(ends, place, side="right")
    whole = hasher.ranges(starts, stops + LENGTH) ^ _mixed(((place - starts) * 4096 + stops - starts).astype(np.uint64))
    return piece, place, starts, stops, hashes[place], whole


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def _slices(batches, rows: int = 400):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that only rows of equal id and text share; such rows have equal results."""
    key = [F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("h")]
    return docs.select(*key, "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _repeated_leads(texts: DataFrame) -> DataFrame:
    def count(batches):
        for batch in _slices(batches):
            for run in pieces(_texts(batch, 0)):
                leads, n = np.unique(anchors(run)[4].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leads), pa.array(n)], names=["lead", "n"])

    counts = texts.select("text").mapInArrow(count, "lead bigint, n bigint").groupBy("lead").agg(F.sum("n").alias("n"))
    return stored(counts.filter("n > 1").select("lead"), "leads")


def _anchored(texts: DataFrame) -> DataFrame:
    """(lead, whole, id, h, place, left, right): how far the anchor's strings reach before and after its place."""

    def find(batches):
        for batch in _slices(batches):
            for run in pieces(_texts(batch, 2)):
                piece, place, starts, stops, lead, whole = anchors(run)
                row = np.array([r for r, _, _ in run])[piece]
                shift = np.array([o for _, o, _ in run]) - np.concatenate([[0], np.cumsum([len(p) for _, _, p in run])[:-1]])
                picked = pa.array(row)
                columns = [
                    pa.array(lead.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(picked),
                    batch.column(1).take(picked), pa.array(place + shift[piece]),
                    pa.array((place - starts).astype(np.int32)), pa.array((stops + LENGTH - place).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lead", "whole", "id", "h", "place", "left", "right"])

    ddl = "lead bigint, whole bigint, id bigint, h bigint, place bigint, left int, right int"
    return texts.select("id", "h", "text").mapInArrow(find, ddl)


def _contexts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The bytes around one anchor of each class: (lead, whole, n, many, left, context)."""
    facts = F.struct("lead", "whole", "n", "many", "left", "right", F.col("one.place").alias("place"))
    wanted = classes.groupBy(F.col("one.id").alias("id"), F.col("one.h").alias("h")).agg(F.collect_list(facts).alias("wanted"))
    once = texts.select("id", "h", "text").join(wanted, ["id", "h"]).select("text", "wanted")
    ddl = "lead bigint, whole bigint, n bigint, many boolean, left int, context binary"

    def cut(batches):
        for batch in _slices(batches, 50):
            rows = [
                (w["lead"], w["whole"], w["n"], w["many"], w["left"], text[w["place"] - w["left"] : w["place"] + w["right"]])
                for text, wanted in zip(_texts(batch, 0), batch.column(1).to_pylist()) for w in wanted
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["lead", "whole", "n", "many", "left", "context"])

    return stored(once.mapInArrow(cut, ddl), "contexts")


def _strings(contexts: list[bytes], lefts: np.ndarray):
    """All 200-byte strings of some contexts: (context, bytes before the anchor, hash)."""
    hasher = _Hasher(np.frombuffer(b"".join(contexts), np.uint8))
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[of] + step
    return of, lefts[of] - step, hasher.ranges(start, start + LENGTH)


_REACH_DDL = "lead bigint, whole bigint, reach int, rest int"


def _gathered(contexts: DataFrame) -> DataFrame:
    """How far repeated strings reach around the anchors of classes whose lead is compared in one task."""
    lead = F.substring("context", F.col("left") + 1, F.lit(LEAD))
    ranged = contexts.withColumn("bytes", lead).repartitionByRange(task_count(contexts.sparkSession), "bytes")
    rows = ranged.sortWithinPartitions("bytes", "lead").select("lead", "whole", "n", "left", "context")

    def reach(group):
        contexts, lefts = [g[4] for g in group], np.array([g[3] for g in group])
        of, before, hashes = _strings(contexts, lefts)
        hashes = _mixed(hashes ^ before.astype(np.uint64))
        _, inverse = np.unique(hashes, return_inverse=True)
        weight = np.bincount(inverse, weights=np.array([g[2] for g in group], float)[of])
        again = weight[inverse] > 1
        found = []
        for at in np.unique(of[again]).tolist():
            own = before[again & (of == at)]
            found.append((group[at][0], group[at][1], int(own.max()), LENGTH - int(own.min())))
        return found

    def compare(batches):
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if group and group[0][0] != row[0]:
                    found.extend(reach(group))
                    group = []
                group.append(row)
            yield _reach_batch(found)
        if group:
            yield _reach_batch(reach(group))

    return rows.mapInArrow(compare, _REACH_DDL)


def _reach_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["lead", "whole", "reach", "rest"])


def _blocks(contexts: DataFrame) -> DataFrame:
    """Blocks of eight neighbouring strings around the anchor: (lead, whole, n, block, core, all, low, high).

    ``core`` is the hash of the bytes all strings of a block have in common, ``all`` that of the bytes of those the context
    has, ``low`` and ``high`` the fewest and most bytes these have before the anchor.
    """

    def cut(batches):
        for batch in _slices(batches, 1000):
            contexts, lefts = _texts(batch, 4), np.asarray(batch.column(3)).astype(np.int64)
            hasher = _Hasher(np.frombuffer(b"".join(contexts), np.uint8))
            sizes = np.array([len(c) for c in contexts])
            fewest = lefts - (sizes - LENGTH)
            counts = lefts // _BLOCK - fewest // _BLOCK + 1
            of = np.repeat(np.arange(len(contexts)), counts)
            block = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + (fewest // _BLOCK)[of]
            low, high = np.maximum(block * _BLOCK, fewest[of]), np.minimum(block * _BLOCK + _BLOCK - 1, lefts[of])
            anchor = (np.cumsum(sizes) - sizes + lefts)[of]
            core = hasher.ranges(anchor - block * _BLOCK, anchor - block * _BLOCK + LENGTH - _BLOCK + 1)
            whole = hasher.ranges(anchor - high, anchor - low + LENGTH) ^ _mixed((low * 4096 + high).astype(np.uint64))
            picked = pa.array(of)
            columns = [batch.column(i).take(picked) for i in range(3)]
            columns += [pa.array(block), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, names=["lead", "whole", "n", "block", "core", "all", "low", "high"])

    ddl = "lead bigint, whole bigint, n bigint, block bigint, core bigint, all bigint, low bigint, high bigint"
    return stored(contexts.select("lead", "whole", "n", "left", "context").mapInArrow(cut, ddl), "blocks")


def _counted(contexts: DataFrame) -> DataFrame:
    """The same for leads with very many classes, by counts that are summed up before they meet.

    A block that several contexts share is settled as a whole; one whose core nobody else has holds no repeated string.
    Only where one core has several kinds of block are the block's strings counted, once for each kind.
    """
    blocks = _blocks(contexts)
    kinds = blocks.groupBy("lead", "block", "core", "all").agg(
        F.sum("n").alias("t"), F.min("whole").alias("one"), F.min("low").alias("low"), F.min("high").alias("high")
    )
    kinds = stored(kinds, "kinds")
    several = kinds.groupBy("lead", "block", "core").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").drop("_k")
    open_ = kinds.join(several, ["lead", "block", "core"])
    wanted = open_.groupBy("lead", F.col("one").alias("whole")).agg(F.collect_list(F.struct("t", "low", "high")).alias("wanted"))
    source = contexts.select("lead", "whole", "left", "context").join(wanted, ["lead", "whole"])

    def spread(batches):
        for batch in _slices(batches, 1000):
            rows = [
                (k, w["t"], before, left)
                for k, (left, many) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()))
                for w in many for before in range(w["low"], w["high"] + 1)
            ]
            of, t, before, left = (np.array(c, np.int64) for c in zip(*rows))
            contexts = _texts(batch, 3)
            sizes = np.array([len(c) for c in contexts])
            start = (np.cumsum(sizes) - sizes)[of] + left - before
            hashes = _Hasher(np.frombuffer(b"".join(contexts), np.uint8)).ranges(start, start + LENGTH)
            picked = pa.array(of)
            columns = [batch.column(i).take(picked) for i in range(2)] + [pa.array(t), pa.array(before), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lead", "whole", "t", "before", "string"])

    ddl = "lead bigint, whole bigint, t bigint, before bigint, string bigint"
    columns = ["lead", "whole", "left", "context", "wanted"]
    strings = stored(source.select(*columns).mapInArrow(spread, ddl), "strings")
    again = strings.groupBy("lead", "string", "before").agg(F.sum("t").alias("_t")).filter("_t > 1").drop("_t")
    met = strings.join(again, ["lead", "string", "before"]).select("lead", "whole", F.col("before").alias("low"), F.col("before").alias("high"))
    settled = blocks.join(kinds.filter("t > 1").select("lead", "block", "core", "all"), ["lead", "block", "core", "all"])
    both = met.unionByName(settled.select("lead", "whole", "low", "high"))
    return both.groupBy("lead", "whole").agg(
        F.max("high").cast("int").alias("reach"), (F.lit(LENGTH) - F.min("low")).cast("int").alias("rest")
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, h, spans) of the texts that have repeated strings; spans (a, b) in bytes may overlap.

    The key is (doc_id, -1 for null; hash of the text), as ``_keyed`` gives it.
    """
    texts = _keyed(docs)
    leads = _repeated_leads(texts)
    found = stored(_anchored(texts).join(leads, "lead"), "anchors")
    one = F.min(F.struct("id", "h", "place")).alias("one")
    grouped = found.groupBy("lead", "whole").agg(
        F.count(F.lit(1)).alias("n"), one, F.min("left").alias("left"), F.min("right").alias("right")
    )
    grouped = stored(grouped, "classes")
    kinds = grouped.groupBy("lead").agg(F.count(F.lit(1)).alias("classes"))
    classes = grouped.join(kinds, "lead").withColumn("many", F.col("classes") > _GATHERED)
    settled = classes.filter("n > 1").select("lead", "whole", F.col("left").alias("reach"), F.col("right").alias("rest"))
    contexts = _contexts(texts, classes.filter("classes > 1"))
    open_ = _gathered(contexts.filter("NOT many")).unionByName(_counted(contexts.filter("many")))
    alone = grouped.filter("n = 1").select("lead", "whole")
    reached = stored(settled.unionByName(open_.join(alone, ["lead", "whole"], "left_semi")), "reaches")
    spans = found.join(reached, ["lead", "whole"]).select(
        "id", "h", (F.col("place") - F.col("reach")).alias("a"), (F.col("place") + F.col("rest")).alias("b")
    )
    return spans.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _runs(spans: list[dict]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: (doc_id, n_bytes, n_removed, n_spans, kept), ``kept`` being the bytes that stay.

    Texts count as UTF-8, null as empty.  A byte goes when a 200-byte string covers it that starts at another place
    too, in the same document or another row; overlapping strings count, and all are judged on the input.  Matches never cross
    documents.  A row that repeats an id and a text repeats the whole text, so both lose what is long enough.
    """
    texts = _keyed(docs)
    joined = texts.join(repeated_spans(docs), ["id", "h"], "left").select("doc_id", "text", "spans")
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"

    def remove(batches):
        for batch in _slices(batches, 200):
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(_texts(batch, 1), batch.column(2).to_pylist()):
                runs = _runs(spans or [])
                cuts = [0, *(p for r in runs for p in r), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                counts.append(len(runs))
                kept.append(rest)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(remove, ddl)
