from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus_fixtures import folder  # noqa: F401

from shelfmark.llm import prefix_trie as trie
from shelfmark.llm.queries import QUERIES

TURNS = "conv_id bigint, turn bigint, role string, text string, d1 string, n int"


def md5(text):
    return hashlib.md5((text or "").encode()).digest()


def plain(rows):
    """All nodes from lists of whole prefixes."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, md5(role), md5(text), role or "", text or ""))
    own = {c: [(r[4], r[5]) for r in sorted(turns)] for c, turns in own.items()}
    path = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        path[conv] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for conv, turns in path.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    out = []
    for key, members in nodes.items():
        below = [(k, m) for k, m in nodes.items() if k[: len(key)] == key]
        ends = sorted(c for c in members if len(path[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            sum(len(k) == len(key) + 1 for k, _ in below),
            sum(not any(len(j) == len(k) + 1 and j[:-1] == k for j, _ in below) for k, _ in below),
            sum((len(m) - 1) * len(k[-1][1]) for k, m in below if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(5)
    texts = ["", "a", "bé", "😀x", "long " * 30]
    rows = []
    for conv in [*range(0, 30), *range(100, 112), 205, 207, 250, -3, -100, -105, 999_999_999_999]:
        for turn in range(rng.choice([1, 2, 7, 11])):
            rows.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice([*texts, None]), "x", 1))
    rows += [(7, None, "user", "first", "x", 1), (7, None, "user", "first", "x", 1), (7, 3, "bot", "tie", "x", 1), (7, 3, "bot", "tie", "x", 1)]
    rows += [(None, 1, "user", "nobody", "x", 1)]
    rows += [(c, t, "u", f"same {t}", "x", 1) for c in (300, 301, 302, 400) for t in range(25)]  # copies, longer than a segment
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_query_equals_plain_tries(spark, folder):  # noqa: F811
    rows = _rows()
    found = QUERIES["op11_prefix_trie"](spark, folder(conversations=spark.createDataFrame(rows, TURNS).repartition(5)))
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("segment,shard_rows", [(2, 1), (3, 20), (5, 10_000)])
def test_long_conversations_are_cut_and_carried(spark, segment, shard_rows):
    rows = _rows()
    turns = trie.ordered_turns(spark.createDataFrame(rows, TURNS))
    ids = turns.groupBy("conv_id").agg({"at": "max"}).toDF("conv_id", "n")
    found = trie.prefix_nodes(trie.with_shared_heads(turns, ids), ids, segment, shard_rows)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_no_conversations_and_conversations_without_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty, shared_heads=True).collect() == []
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 100)}
    conv = next(c for c, k in h.items() if k >= 2)  # its one turn goes, and conversation 0 is not there
    rows = [(conv, 0, "u", "gone", "x", 1)]
    found = trie.prefix_trie(spark.createDataFrame(rows, TURNS), shared_heads=True).collect()
    assert list(map(tuple, found)) == plain(rows) and found[0].n_leaves == 1 and found[0].depth == 0


def test_hash_is_minimal_and_perfect():
    draw = np.random.default_rng(3)
    first, second = draw.integers(-(1 << 63), 1 << 63, 5000), draw.integers(0, 3, 5000)
    table = trie.SlotTable(first, second)
    assert sorted(table.slots(first, second).tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        table.slots(first[:1] + 1, second[:1])
