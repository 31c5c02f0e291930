"""Hard negatives and nearest neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from corpus_fixtures import folder  # noqa: F401
from pyspark.sql import functions as F

from shelfmark.llm import hard_negatives as hn
from shelfmark.llm import nearest
from shelfmark.llm import vector_blocks as vb
from shelfmark.llm.queries import QUERIES

# Column names that the operators use themselves.
TABLE = "vec_id bigint, embedding array<float>, label int, uid string, rank string, score string, g string, norm string"
CLASH = ("x", "x", "x", "x", "x")


def _vectors(count=420, dim=6, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((8, dim))
    points = centres[draw.integers(0, 8, count)] + 0.3 * draw.standard_normal((count, dim))
    rows = [(i, [float(np.float32(x)) for x in p], int(draw.integers(0, 10)), *CLASH) for i, p in enumerate(points)]
    rows += [(1000 + i, rows[0][1], i % 3, *CLASH) for i in range(150)]  # one vector many times
    rows += [rows[100], (200, rows[5][1], 4, *CLASH)]  # a row twice, an id twice
    rows += [
        (700, None, 1, *CLASH), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, *CLASH), (900, [math.nan] * dim, 1, *CLASH),
        (901, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1, *CLASH), (902, rows[3][1], None, *CLASH), (None, rows[3][1], 1, *CLASH),
        (903, [0.0] * dim, 2, *CLASH), (904, [], 2, *CLASH), (905, rows[0][1][:2], 2, *CLASH),
    ]
    return rows


def _padded(vector, dim):
    return [*vector, *[0.0] * (dim - len(vector))]


def _fine(row):
    return row[0] is not None and row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def plain_negatives(rows, dim=6):
    used = []
    for row in rows:
        if _fine(row) and row[2] is not None:
            label = (row[2] + 1) % 10 if row[0] % 7 == 0 else row[2]
            used.append((row[0], label, [math.floor(256 * x) for x in _padded(row[1], dim)]))
    out = []
    for a, (anchor, label, vector) in enumerate(used):
        if anchor % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(vector, v)), i, other) for b, (i, other, v) in enumerate(used) if b != a
        )
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            out += [(anchor, positive, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(window[:5], 1)]
    return sorted(out)


def test_negatives_equal_comparing_all(spark, folder):  # noqa: F811
    rows = _vectors()
    found = QUERIES["op12_hard_negatives"](spark, folder(embeddings=spark.createDataFrame(rows, TABLE).repartition(3)))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.select(*columns).collect())) == plain_negatives(rows)


@pytest.mark.parametrize("shard_rows", [50, 300])
def test_trees_find_the_best_of_all(spark, shard_rows):
    rows = hn.quantised(spark.createDataFrame(_vectors(900), TABLE))
    index = hn.Index(rows, sample_rows=100, shard_rows=shard_rows)
    ends = {"qid": F.col("uid"), "low": F.lit(-2e5), "high": F.lit(3e5), "same": F.lit(False)}
    found = index.search(index.rows.filter("vec_id % 10 = 3").withColumns(ends), 7).collect()
    held = [(r.uid, r.vec_id, r.label, np.array(_padded(r.vector, 6))) for r in rows.collect()]
    for uid, vec_id, label, vector in held:
        if vec_id % 10 == 3:
            scores = [(int(v @ vector), i) for u, i, other, v in held if u != uid and other != label]
            best = sorted((-s, i) for s, i in scores if -2e5 <= s <= 3e5)[:7]
            assert sorted((r.rank, -r.score, r.vec_id) for r in found if r.qid == uid) == [(n, *b) for n, b in enumerate(best, 1)]


def test_boxes_bound_every_row():
    draw = np.random.default_rng(7)
    vectors = draw.integers(-300, 300, (1000, 5))
    ids = np.arange(1000)
    tree = hn.Tree([*[ids.astype(np.int64).tobytes()] * 3, vectors.tobytes(), vectors.dtype.str.encode()])
    whole = np.array([[-1e9], [1e9]])
    query = draw.integers(-300, 300, (1, 5))
    block = hn.Queries([*[np.zeros(1, np.int64).tobytes()] * 3, *[w.tobytes() for w in whole], b"\0", query.tobytes()], 3)
    for level, (low, high) in enumerate(tree.levels):
        rows = hn._PAGE_ROWS * hn._FANOUT**level
        most = block.bounds(np.array([0]), low, high)[0]
        for node, bound in enumerate(most):
            assert (vectors[node * rows : (node + 1) * rows] @ query[0]).max() <= bound
    assert len(tree.levels[-1][0]) == 1


def test_vectors_too_large_to_score_are_an_error(spark):
    rows = spark.createDataFrame([(1, [3e7], 1), (2, [1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hn.Index(hn.quantised(rows))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_nearest_vectors"])
def test_tables_without_any_usable_vector(spark, folder, name):  # noqa: F811
    bad = [(100, None, 1, *CLASH), (200, [math.nan], 1, *CLASH), (None, [1.0], 1, *CLASH)]
    for rows in ([], bad, [*bad, (300, [1.0, 2.0], 1, *CLASH)]):
        path = folder(embeddings=spark.createDataFrame(rows, TABLE))
        assert QUERIES[name](spark, path).collect() == []


def plain_nearest(rows, dim=6, k=10):
    used = [(r[0], np.array(_padded(r[1], dim))) for r in rows if _fine(r) and any(r[1])]
    for a, (query, vector) in enumerate(used):
        if query % 100 == 0:
            gaps = [(float(np.sqrt(((v - vector) ** 2).sum())), i) for b, (i, v) in enumerate(used) if b != a]
            yield query, sorted(gaps)[:k]


def test_nearest_against_brute_force(spark, folder):  # noqa: F811
    rows = _vectors(2000)
    found = QUERIES["op13_nearest_vectors"](spark, folder(embeddings=spark.createDataFrame(rows, TABLE).repartition(3))).collect()
    hit = wanted = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r.rank, round(r.score, 9), r.vec_id))
    truth = {}
    for query, best in plain_nearest(rows):
        truth.setdefault(query, []).extend((n, round(d, 9), i) for n, (d, i) in enumerate(best, 1))
    for query, best in truth.items():
        mine = by_query[query]
        assert len(mine) == len(best)
        assert sorted(r for r, _, _ in mine) == sorted(r for r, _, _ in best)
        hit += len({(d, i) for _, d, i in best} & {(d, i) for _, d, i in mine})
        wanted += len({(d, i) for _, d, i in best})
    assert set(by_query) == set(truth) and hit >= 0.97 * wanted
    # The copies of one vector: the ten smallest ids, at distance zero.
    assert sorted(by_query[0])[:3] == [(1, 0.0, 1000), (2, 0.0, 1001), (3, 0.0, 1002)]


def test_probing_retrieves_every_code_within_the_radius():
    draw = np.random.default_rng(9)
    vectors = draw.standard_normal((600, 12))
    ids = np.arange(600)
    codes = nearest.Codes(vectors, 0.1, 10.0, 5)
    shard = nearest.Shard(nearest.Shard.parts(ids, ids, vectors, codes.of(vectors)))
    for step in range(0, nearest.SUBSTRING, 3):
        code = codes.of(vectors[:1])[0]
        probed = shard.holding(np.flatnonzero(shard.apart(code) <= step))
        bits = np.bitwise_count(shard.codes ^ code)
        assert probed[bits.sum(axis=1) <= len(code) * (step + 1) - 1].all()
        assert (probed == (bits.min(axis=1) <= step)).all()


def test_rotation_is_orthogonal_and_angles_are_bounds():
    draw = np.random.default_rng(1)
    turn = nearest.learned_rotation(draw.standard_normal((200, 9)), 10, 3)
    assert np.allclose(turn @ turn.T, np.eye(9))
    x = draw.standard_normal(9)
    y = draw.standard_normal((500, 9)) * draw.uniform(0.2, 3, (500, 1))
    norms = np.linalg.norm(y, axis=1)
    widest = nearest.angle_within(np.linalg.norm(y - x, axis=1), np.linalg.norm(x), norms.min(), norms.max())
    assert (np.arccos(np.clip(y @ x / norms / np.linalg.norm(x), -1, 1)) <= widest + 1e-9).all()


def test_runs_and_padding():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[1.0], [], [1.0, 2.0]])], names=["v"])
    assert [t.num_rows for t in vb.runs(iter([batch, batch]), 4)] == [4, 2]
    assert vb.matrix(batch.column(0), 2, np.float64).tolist() == [[1, 0], [0, 0], [1, 2]]
