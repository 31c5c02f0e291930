"""Benchmark passages in training texts through a positional inverted index.

The index is sharded by documents: each row holds the postings of one run of whole documents, term by term, with the
positions of all of them on one line that keeps documents apart.  No posting list is ever gathered from several tasks,
so a word that is in every document costs each shard its own share only.  The index is stored, and the search reads it
back: for each window of a benchmark item it takes the list of the term that is rarest over all shards, moves it by the
term's place in the window, and intersects it with the lists of the next rarest terms until none is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import all_slices, as_bytes, stored

WINDOW = 10
# Fixed value: a word is a run of digits, letters a-z and anything beyond ASCII, after A-Z were lower-cased.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHARD_BYTES = 4 << 20
_BLOCK_WORDS = 500_000

_INDEX = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())),
    ]
)
_INDEX_DDL = (
    "doc_ids array<bigint>, digests array<binary>, starts array<int>, lengths array<int>, terms array<int>, counts array<int>, "
    "positions array<int>"
)
_HITS = pa.schema(
    [
        ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("froms", pa.list_(pa.int64())),
        ("tos", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())),
    ]
)
_HITS_DDL = (
    "doc_id bigint, digest binary, n_words bigint, froms array<bigint>, tos array<bigint>, items array<string>, "
    "near_items array<string>"
)


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def item_blocks(items: DataFrame, limit: int = _BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark as blocks of whole items with about ``limit`` words each: (item id, words).

    Items arrive one by one, so the driver holds one block at a time.  An item without an id has the empty id.
    """
    block, size = [], 0
    ident = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    for row in items.select(ident, "text").toLocalIterator():
        found = words((row.text or "").encode())
        if found:
            block.append((row.item_id, found))
            size += len(found)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int) -> DataFrame:
    """Stored postings of the words in ``vocabulary``; other words keep their positions but can be in no match.

    Documents of a shard lie ``gap`` positions apart.
    """

    def index(batches):
        for part in all_slices(batches, 1, _SHARD_BYTES):
            starts, lengths, ids, at = [], [], [], 0
            texts = as_bytes(part.column(1))
            for text in texts:
                found = [vocabulary.get(w, -1) for w in words(text)]
                starts.append(at)
                lengths.append(len(found))
                ids.append(np.array(found, np.int32))
                ids.append(np.full(gap, -1, np.int32))
                at += len(found) + gap
            line = np.concatenate(ids)
            places = np.flatnonzero(line >= 0)
            order = places[np.argsort(line[places], kind="stable")].astype(np.int32)
            terms, counts = np.unique(line[places], return_counts=True)
            digests = [md5(t).digest() for t in texts]
            rows = [part.column(0).to_pylist(), digests, starts, lengths, terms, counts.astype(np.int32), order]
            yield pa.RecordBatch.from_arrays([pa.array([r], f.type) for r, f in zip(rows, _INDEX)], schema=_INDEX)

    return stored(docs.select("doc_id", "text").mapInArrow(index, _INDEX_DDL), "postings")


def term_totals(index: DataFrame) -> dict[int, int]:
    """Occurrences of each term over all shards; there are at most as many terms as the block has words."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    totals = pairs.groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    return {row.terms: row.n for row in totals.toLocalIterator()}


def _plans(block, vocabulary: dict[bytes, int], totals: dict[int, int], width: int):
    """Distinct windows: (term and place pairs from the rarest on, items that have the window)."""
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, found in block:
        ids = [vocabulary[w] for w in found]
        for at in range(max(1, len(ids) - width + 1)):
            owners.setdefault(tuple(ids[at : at + width]), set()).add(item)
    plans = []
    for window, items in owners.items():
        if all(t in totals for t in window):
            steps = sorted(((t, place) for place, t in enumerate(window)), key=lambda s: (totals[s[0]], s[1]))
            plans.append((steps, len(window), sorted(items)))
    return plans


def _in_order(values: np.ndarray, starts: np.ndarray, places: list[int], slack: list[int]) -> np.ndarray:
    """Which starts have, for each of one term's places, an occurrence of its own at most its slack off, in order.

    Each place takes the first occurrence that is left for it, which leaves most for the next ones.
    """
    found, at = np.ones(len(starts), bool), np.full(len(starts), -1)
    for place, off in zip(places, slack):
        at = np.maximum(at + 1, np.searchsorted(values, starts + (place - off)))
        found &= at < len(values)
        found &= values[np.minimum(at, len(values) - 1)] <= starts + (place + off)
    return found


def _near(values: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """Which wanted places have a value at most ``slack`` away; values are sorted."""
    at = np.searchsorted(values, wanted - slack)
    inside = at < len(values)
    return inside & (values[np.minimum(at, len(values) - 1)] <= wanted + slack)


def _matches(postings: dict[int, np.ndarray], steps, slack: int) -> np.ndarray:
    """Window starts at which each term stands at its place, or at most ``slack`` off it.

    The rarest term's first place is where the window is hung up and has no slack.  A term that the window has several times
    needs as many occurrences, in order.
    """
    rarest, hook = steps[0]
    starts = postings[rarest] - hook
    for term, place in steps[1:]:
        if not len(starts):
            return starts
        starts = starts[_near(postings[term], starts + place, slack)]
    if slack and len(starts):
        for term, count in Counter(term for term, _ in steps).items():
            if count > 1:
                own = sorted(place for other, place in steps if other == term)
                off = [0 if term == rarest and place == hook else slack for place in own]
                starts = starts[_in_order(postings[term], starts, own, off)]
    return starts


def _runs(hit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hit words: first word, word after the last, document; documents are apart, so no run crosses."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    froms = np.flatnonzero(edges == 1)
    return froms, np.flatnonzero(edges == -1), np.searchsorted(starts, froms, side="right") - 1


def search_index(index: DataFrame, plans, slack: int) -> DataFrame:
    """Per document of the index: words, runs of words inside exact occurrences, items with exact and near ones.

    Windows are listed under their rarest term, so a shard looks only at those whose rarest term it has.
    """
    by_rarest: dict[int, list] = {}
    for plan in plans:
        by_rarest.setdefault(plan[0][0][0], []).append(plan)

    def search(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                starts, lengths = np.array(shard["starts"]), np.array(shard["lengths"])
                ends = np.cumsum(shard["counts"])
                lists = np.split(np.array(shard["positions"], np.int64), ends[:-1]) if len(ends) else []
                postings = dict(zip(shard["terms"], lists))
                size = int(starts[-1] + lengths[-1])
                cover = np.zeros(size + 1, np.int64)
                exact: list[set[str]] = [set() for _ in starts]
                near: list[set[str]] = [set() for _ in starts]
                for steps, width, items in (plan for term in postings for plan in by_rarest.get(term, ())):
                    if any(term not in postings for term, _ in steps):
                        continue
                    found = _matches(postings, steps, slack)
                    for doc in set((np.searchsorted(starts, found + steps[0][1], side="right") - 1).tolist()):
                        near[doc].update(items)
                    if slack and len(found):
                        found = _matches(postings, steps, 0)
                    np.add.at(cover, found, 1)
                    np.add.at(cover, found + width, -1)
                    for doc in set((np.searchsorted(starts, found, side="right") - 1).tolist()):
                        exact[doc].update(items)
                froms, tos, of = _runs(np.cumsum(cover)[:size] > 0, starts)
                cuts = np.searchsorted(of, np.arange(1, len(starts)))
                rows = [
                    shard["doc_ids"], shard["digests"], lengths, np.split(froms - starts[of], cuts),
                    np.split(tos - starts[of], cuts), [sorted(e) for e in exact], [sorted(n) for n in near],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _HITS)], schema=_HITS)

    return index.mapInArrow(search, _HITS_DDL)


def benchmark_hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, slack: int = 2) -> DataFrame:
    """One row per document row: (doc_id, digest, n_words, n_hit, items, near_items), the digest being the text's MD5.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.  ``n_hit``
    counts the words inside exact occurrences, ``items`` are the item ids with one, sorted as strings, and
    ``near_items`` those with a proximity match: every word at most ``slack`` places off its own, counted from the
    rarest word, and a word that the window has several times as often and in order.  Items that repeat an id count as one.  A null text has no words; other columns are not read.

    A benchmark of more than half a million words is searched in blocks of whole items, with an index for each, and
    the runs of hit words are united per document.
    """
    parts = []
    for block in item_blocks(items):
        vocabulary = {w: at for at, w in enumerate(Counter(w for _, found in block for w in found))}
        index = build_index(docs, vocabulary, gap=width + 2 * slack + 1)
        plans = _plans(block, vocabulary, term_totals(index), width)
        parts.append(search_index(index, plans, slack))
    if not parts:
        parts.append(search_index(build_index(docs, {}, gap=1), [], slack))
    found = parts[0] if len(parts) == 1 else _united(parts)
    hit_words = F.aggregate(F.zip_with("froms", "tos", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return found.select("doc_id", "digest", "n_words", hit_words.alias("n_hit"), "items", "near_items")


def _united(parts: list[DataFrame]) -> DataFrame:
    """One row per document row from the results of several blocks."""
    rows = reduce(DataFrame.unionByName, parts)
    both = rows.groupBy("doc_id", "digest", "n_words").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("froms", "tos")],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")],
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("_copies"),
    )

    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def unite(froms: pa.Array, tos: pa.Array) -> pa.Array:
        found = []
        for low, high in zip(froms.to_pylist(), tos.to_pylist()):
            runs: list[list[int]] = []
            for a, b in sorted(zip(low, high)):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            found.append([{"a": a, "b": b} for a, b in runs])
        return pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    united = both.withColumn("_runs", unite("froms", "tos"))
    return united.withColumns({"froms": F.col("_runs.a"), "tos": F.col("_runs.b")}).select(
        *parts[0].columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")
    )
