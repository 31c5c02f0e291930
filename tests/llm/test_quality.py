from __future__ import annotations

import zlib

from corpus_fixtures import docs, folder  # noqa: F401

from shelfmark.llm.queries import QUERIES
from shelfmark.llm.quality import _monotone, statistics_of

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in QUERIES["op10_quality_score"](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in found.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(r.quality, found[r.doc_id]) for r in labels if found[r.doc_id].held_out]
    assert len(held) > 500
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.97
    good, bad = ([r.score for q, r in held if q == k] for k in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, docs, folder):
    texts = [("Some plain words here. " * (3 + i % 5), 1) if i % 3 else ("AA!! " * (9 + i % 7), 0) for i in range(90)]
    rows = docs(*[(i, t) for i, (t, _) in enumerate(texts)], (None, None), (1000, ""), (1000, ""))
    def labels(flip):
        out = [(i, 1 - q if flip and zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, (_, q) in enumerate(texts)]
        return spark.createDataFrame([*out, (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    results = [
        sorted(map(tuple, QUERIES["op10_quality_score"](spark, folder(documents=rows, labels=labels(f))).collect()), key=str)
        for f in (False, True)
    ]
    assert [r[:2] for r in results[0]] == [r[:2] for r in results[1]] and len(results[0]) == 93
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(*results))


def test_nothing_to_learn_from(spark, docs, folder):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = QUERIES["op10_quality_score"](spark, folder(documents=docs((1, "a"), (2, None)), labels=labels)).collect()
    assert [(r.score, r.predicted) for r in found] == [(0.5, 0)] * 2
    assert QUERIES["op10_quality_score"](spark, folder(documents=docs(), labels=labels)).count() == 0


def test_monotone():
    assert _monotone([3, 1, 2, 5, 4], [1, 1, 2, 1, 1]).tolist() == [2, 2, 2, 4.5, 4.5]
    assert len(set(map(len, (statistics_of(b""), statistics_of(b"x"), statistics_of(b"a b\n" * 9))))) == 1
