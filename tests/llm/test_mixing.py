from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from corpus_fixtures import docs, folder  # noqa: F401
from pyspark.sql import functions as F

from shelfmark.llm.mixing import mix, source_targets, taken_per_document
from shelfmark.llm.queries import QUERIES


def plain_targets(sizes):
    """Shares by weight; what is over three times a source's size is shared anew until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        level = left / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        for s in over:
            fixed[s] = 3 * sizes[s]
            left -= 3 * sizes[s]


def _rows():
    rng = random.Random(2)
    sources = ["b", "a", "é", "Z", None, "", "tiny"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choices(sources, [60, 5, 5, 5, 5, 5, 0])[0]) for i in range(400)]
    return rows + [(1000, "one", "tiny"), (1001, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (5, "p q\x0br", "b"), (5, "p q\x0br", "b")]


def test_query(spark, docs, folder):
    rows = _rows()
    sizes = defaultdict(int)
    count = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    for _, text, source in rows:
        sizes[source] += count(text)
    targets = plain_targets(sizes)
    where = folder(documents=docs(*rows))
    found = QUERIES["op9_source_mix"](spark, where).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, QUERIES["op9_source_mix"](spark, where).collect()), key=str)
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in found) == sorted(
        (i is None, i, count(t)) for i, t, _ in rows
    )
    by_size = {(sizes[s], round(t, 6)) for s, t in targets.items()}
    assert {(r.source_size, round(r.target, 6)) for r in found} == by_size
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for key, words in taken.items():
        same = sum((s, round(t, 6)) == key for s, t in ((sizes[n], targets[n]) for n in targets))
        assert abs(words - same * key[1]) <= same


def test_slices_interleave_sources(spark, docs):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(200)]
    documents, taken = mix(docs(*rows), block=100)
    first = taken.filter("slot < 40").groupBy("source").agg(F.sum("words").alias("n")).collect()
    share = {r.source: r.n / 4000 for r in first}
    assert abs(share["a"] - 5 / 7) < 0.1 and abs(share["b"] - 2 / 7) < 0.1
    assert taken_per_document(documents, taken).agg(F.sum("taken")).first()[0] == 10_000


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "x")]])
def test_nothing_to_mix(spark, docs, folder, rows):
    found = QUERIES["op9_source_mix"](spark, folder(documents=docs(*rows))).collect()
    assert [(r["size"], r.taken) for r in found] == [(0, 0)] * len(rows)


def test_many_sources_reach_their_level(spark):
    rows = [(f"s{i:03}", 1 + (i * 37) % 50) for i in range(120)]
    sized = spark.createDataFrame([(s, n) for s, n in rows], "source string, size bigint")
    found = {r.source: r.target for r in source_targets(sized).collect()}
    expected = plain_targets(dict(rows))
    assert found == pytest.approx(expected)
