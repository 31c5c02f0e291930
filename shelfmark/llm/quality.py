"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics of each text become standard scores; a random cosine map of them approximates a Gaussian kernel.  Each
task adds up its share of the normal equations, Spark adds up the shares, and the driver solves one system whose size
is the number of features.  Rows set aside from that fit calibrate the result: their mean label per score bin is made
monotone and read off by interpolation.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 256
RIDGE = 1e-3
BINS = 1000
LEAST = 0.7  # a score from here on is accepted
_CALIBRATION_SHARE = 5  # one labelled row in so many

_CLASS = np.zeros(256, np.int64)
for _name, _chars in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?'\"()-", bytes(range(128, 256))),
    start=1,
):
    _CLASS[list(_chars)] = _name
_STATISTICS = 18


def held_out_of(doc_id: Column) -> Column:
    """Rows that no model may learn from; a row without an id is not among them, as it can have no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def statistics_of(text: bytes) -> list[float]:
    """Numbers about the form of a text, none about what it says; all are 0 for an empty text."""
    if not text:
        return [0.0] * _STATISTICS
    n = len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / n
    words = text.split()
    many = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = text.split(b"\n")
    distinct = len(set(words))
    ends = sum(not w[-1:].isalnum() and w[-1:] < b"\x80" for w in words)
    return [
        np.log1p(n), *kinds.tolist(), float(lengths.mean()), float(lengths.std()), np.log1p(distinct),
        distinct / many**0.75, sum(map(eq, words, words[1:])) / many, ends / many,
        len(zlib.compress(text, 1)) / n, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
    ]


def text_statistics(text: Column) -> Column:
    """Array of statistics of each whole text; null counts as empty."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.binary())
        return pa.array([statistics_of(v.as_py() or b"") for v in values], pa.list_(pa.float64()))

    return measure(text)


@dataclass(frozen=True)
class QualityModel:
    """A fitted scorer of bounded size; ``weights`` is None where no label was there to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return _mapped(statistics, self.mean, self.scale) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(statistics), 0.5)
        return np.interp(self.raw(statistics), self.knots, self.levels)


def _mapped(statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standard scores, drawn from a fixed seed, and a constant."""
    draw = np.random.default_rng(20)
    slopes = draw.normal(size=(_STATISTICS, FEATURES)) / np.sqrt(_STATISTICS)
    shifts = draw.uniform(0, 2 * np.pi, FEATURES)
    standard = np.clip((statistics - mean) / scale, -6, 6)
    cosines = np.sqrt(2 / FEATURES) * np.cos(standard @ slopes + shifts)
    return np.hstack([cosines, np.ones((len(statistics), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), _STATISTICS)


def _shares(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of the normal equations: each task gives its own, row by row of the matrix, and Spark adds them up."""
    width = FEATURES + 2  # the features, the constant and the label

    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                mapped = _mapped(_matrix(batch.column(0)), mean, scale)
                full = np.hstack([mapped, np.asarray(batch.column(1), np.float64)[:, None]])
                total += full.T @ full
        cells = [pa.array(np.arange(width * width)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(cells, names=["cell", "part"])

    parts = rows.select("statistics", "label").mapInArrow(add, "cell bigint, part double")
    cells = parts.groupBy("cell").agg(F.sum("part").alias("total")).toPandas()
    full = np.zeros(width * width)
    full[cells["cell"]] = cells["total"]
    full = full.reshape(width, width)
    return full[:-1, :-1], full[:-1, -1], round(full[-2, -2])


def _monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence: neighbours that fall are pooled until none does."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[2] += n
    return np.concatenate([np.full(n, v) for v, _, n in pools])


def fit_quality(measured: DataFrame, labels: DataFrame, usable: Column) -> QualityModel:
    """Fit on the rows of ``measured`` (doc_id, statistics) that have a label and are ``usable``.

    ``labels`` is (doc_id, quality).  Rows without an id or a label are left out; a repeated label counts each time.
    All usable labelled rows are used; what reaches the driver is bounded by the number of features and bins.
    """
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = measured.join(known, "doc_id").filter(usable).select("doc_id", "statistics", "label")
    moments = rows.select(
        *[F.avg(F.col("statistics")[i]).alias(f"m{i}") for i in range(_STATISTICS)],
        *[F.stddev_pop(F.col("statistics")[i]).alias(f"s{i}") for i in range(_STATISTICS)],
    ).first()
    nothing = np.zeros(1)
    if moments["m0"] is None:
        return QualityModel(nothing, nothing, None, nothing, nothing)
    mean = np.array([moments[f"m{i}"] for i in range(_STATISTICS)])
    scale = np.maximum([moments[f"s{i}"] for i in range(_STATISTICS)], 1e-6)
    aside = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(_CALIBRATION_SHARE)) == 0
    normal, target, count = _shares(rows.filter(~aside), mean, scale)
    if count == 0:
        return QualityModel(nothing, nothing, None, nothing, nothing)
    weights = np.linalg.solve(normal + RIDGE * count * np.eye(len(normal)) / FEATURES, target)
    linear = QualityModel(mean, scale, weights, nothing, nothing)

    @F.arrow_udf("double")
    def raw(statistics: pa.Array) -> pa.Array:
        return pa.array(linear.raw(_matrix(statistics)))

    scored = rows.filter(aside).select(raw("statistics").alias("raw"), "label")
    slot = F.least(F.greatest(F.floor((F.col("raw") + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = scored.groupBy(slot.alias("slot")).agg(
        F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count(F.lit(1)).alias("n")
    )
    table = bins.toPandas().sort_values("raw")
    if not len(table):  # too few rows to set some aside
        knots = np.array([0.0, 1.0])
        return QualityModel(mean, scale, weights, knots, knots)
    levels = _monotone(table["label"].to_numpy(float), table["n"].to_numpy(float))
    # Ties of the calibrated steps keep the order of the raw scores within a narrow band.
    knots = table["raw"].to_numpy(float)
    levels = np.clip(0.98 * levels + 0.02 * np.clip(knots, 0, 1), 0, 1)
    return QualityModel(mean, scale, weights, knots, levels)


def quality_score(statistics: Column, model: QualityModel) -> Column:
    """Calibrated score between 0 and 1 of the statistics of a text; 0.5 where the model had nothing to learn from."""

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)))

    return score(statistics)
