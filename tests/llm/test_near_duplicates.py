from __future__ import annotations

import random
import re

import numpy as np
import pytest
from corpus_fixtures import docs, folder  # noqa: F401

from shelfmark.llm import near_duplicates as nd
from shelfmark.llm.components import connected, lowered
from shelfmark.llm.queries import QUERIES


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x20\\x09-\\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, percent):
    sets = [(i, plain_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if None in (i, j) or not a or not b or 100 * len(a & b) < percent * len(a | b):
                    continue
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    return sorted(((i, len(s), label.get(i), i is None or label[i] == i) for i, s in sets), key=str)


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def _rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(500)]
    base = rng.choices(vocabulary, k=150)
    rows = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 60])))) for i in range(20)]
    ids = rng.sample(range(200, 1200), 60)
    for i in ids:  # near copies around the threshold, each of its own
        words = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3])):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, "Same TEXT") for i in (9, 8, 8, 7)] + [(1, None), (2, ""), (3, " \t"), (None, "Same text"), (None, None)]
    rows += [(4, "İ x\x1cy z\x0bq"), (5, "İ x\x1cy Z q"), (6, "word " * 3000)]
    return rows


@pytest.mark.parametrize("limit", [None, 0])
def test_query_equals_comparing_all(spark, docs, folder, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(nd, "_PAIRS_PER_NODE", limit)
        monkeypatch.setattr(nd, "_LEADER_ROUNDS", 2)
    rows = _rows()
    found = QUERIES["op5_near_duplicates"](spark, folder(documents=docs(*rows)))
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 85)


@pytest.mark.parametrize("band_nodes", [0, 3])
def test_bands_compared_in_joins_give_the_same(spark, docs, band_nodes):
    rows = _rows()
    found = nd.near_duplicates(docs(*rows), 85, band_nodes).select(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 85)


def test_many_similar_texts_that_are_not_linked(spark, docs):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(500):  # most pairs lie between 0.5 and 0.85, some above
        words = list(base)
        for at in rng.sample(range(300), rng.choice([2, 6, 9, 12])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = nd.near_duplicates(docs(*rows), 85).select(COLUMNS)
    expected = plain(rows, 85)
    assert 1 < len({c for _, _, c, _ in expected}) < 500
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_sketches_rarely_miss_a_pair():
    assert nd.least_agreement(85, 180) == 128 and nd.least_agreement(100, 10) == 10
    draw = np.random.default_rng(3)
    agreed = draw.binomial(180, 0.85, 200_000)
    assert (agreed < nd.least_agreement(85, 180)).sum() <= 3


def test_whole_bands_across_batches():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(4).integers(0, 40, 300))
    for size in (1, 7, 64, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[at : at + size])], names=["bucket"]) for at in range(0, 300, size)]
        tables = list(nd.whole_bands(iter(batches)))
        seen = [set(t["bucket"].to_pylist()) for t in tables]
        assert sum(t.num_rows for t in tables) == 300 and sum(map(len, seen)) == len(set().union(*seen))


def test_empty_table(spark, docs):
    assert nd.near_duplicates(docs()).count() == 0


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 1200, dtype=np.uint64)
    left, right = np.sort(values[:1000]), np.sort(values[200:])
    a, b = nd.signatures([left, right], 1000)
    assert abs((a == b).mean() - 800 / 1200) < 0.06
    assert nd.bands_for(85) == 30 and nd.bands_for(80) > nd.bands_for(85)


def test_connected(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    found = {r.nid: r.root for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)}


def _by_root(found):
    groups = {}
    for row in found.collect():
        groups.setdefault(row.root, set()).add(row.nid)
    return groups


def test_lowered_links_connect_the_same(spark):
    rng = random.Random(8)
    nodes = [(group * 1000 + rng.randrange(40), group * 1000 + rng.randrange(40)) for group in range(30) for _ in range(90)]
    links = spark.createDataFrame([*nodes, (-5, 3), (70_000, 70_000)], "a bigint, b bigint")
    low = lowered(links).collect()
    assert all(a < b for a, b in low) and len(set(low)) == len(low)
    assert _by_root(connected(lowered(links))) == _by_root(connected(links))
    assert lowered(links.limit(0)).count() == 0


def test_bands_of_near_copies_join_few_links(spark, docs, monkeypatch):
    rng, seen = random.Random(10), []
    base = [f"w{at}" for at in range(400)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(400), 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(nd, "connected", lambda links: seen.append(links.count()) or connected(links))
    found = nd.near_duplicates(docs(*rows), 85).select(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 85)
    assert seen and seen[0] < 2 * len(rows)
