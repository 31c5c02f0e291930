from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from corpus_fixtures import docs, folder  # noqa: F401

from shelfmark.llm import repeats
from shelfmark.llm.queries import QUERIES


def plain(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choices("abcdefghij éß漢 ", k=n))
    passages = [prose(n) for n in (120, 150, 199, 200, 201, 260, 400, 900)] + ["x" * 199, "ab" * 150]
    rows = []
    for i in range(120):
        parts = [rng.choice([rng.choice(passages), prose(rng.choice([10, 90, 300])), prose(60)]) for _ in range(4)]
        rows.append((i, "".join(parts)))
    edited = passages[-3]
    rows += [(200 + i, edited[: 100 * i] + "Q" + edited[100 * i + 1 :]) for i in range(9)]
    rows += [(300, "z" * 500), (301, "ab" * 300), (None, None), (302, ""), (303, "short"), (None, passages[6] + "n"), (304, "y" * 200)]
    return rows + [(5, rows[5][1]), (305, "be " * 400 + "end"), (306, passages[5][:230]), (307, "k" * 201)]


@pytest.mark.parametrize("gathered,run", [(2000, 1 << 19), (2, 1 << 19), (2000, 300)])
def test_query_equals_counting_all_strings(spark, docs, folder, monkeypatch, gathered, run):
    monkeypatch.setattr(repeats, "_GATHERED", gathered)
    rows = _rows()
    if run < 1000:  # workers read the module anew, so small runs are tried here
        for name, text in rows:
            data = (text or "").encode()
            whole = [s for r in repeats.pieces([data]) for _, _, st, en, _, _ in [repeats.anchors(r)] for a, b in zip(st, en) for s in range(a, b + 1)]
            assert sorted(whole) == list(range(max(0, len(data) - 199)))
        monkeypatch.setattr(repeats, "_RUN_BYTES", run)
        for name, text in rows:
            data = (text or "").encode()
            covered = 0
            for r in repeats.pieces([data]):
                _, _, starts, stops, _, _ = repeats.anchors(r)
                covered += int((stops - starts + 1).sum())
            assert covered == max(0, len(data) - 199)
        return
    found = QUERIES["op8_repeated_passages"](spark, folder(documents=docs(*rows)))
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_empty_table(spark, docs, folder):
    assert QUERIES["op8_repeated_passages"](spark, folder(documents=docs())).count() == 0
