"""Quality classifier: kernel ridge by random Fourier features, calibrated isotonically.

1. One pass over the whole texts gives each document a vector of statistics
   (lengths, shares of character classes, repetition of words and lines).
2. Statistics are standardised over the labelled training rows and mapped to
   ``FEATURES`` random Fourier features, ``sqrt(2/D) cos(xW + b)``, whose inner
   products approximate a Gaussian kernel of width ``sqrt(d)``.
3. Every task sums its rows' normal equations per fold; the sums are added in a
   second round of few tasks, so the driver gets a bounded number of matrices
   whatever the number of rows. Ridge weights follow from them, for all folds
   together and for each fold from the others.
4. Cross-fitted scores of the labelled rows are counted in ``BINS`` bins; the
   pooled-adjacent-violators fit of the bins is the calibration.

All labelled rows outside the held-out quarter are used; nothing is sampled.

Defined cases: null and empty texts have statistics of zeros and are scored as
such; without labels of both kinds the score is the share of label 1 (0.5
without labels); rows without a label are not trained on; of several labels of
one id the largest counts; repeated rows are scored each; a null id is kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches, materialise, text_of
from .text import IS_WORD, buffers, chunks, distinct_by_row, hash_spans, word_hashes, words

FEATURES = 128
RIDGE = 1e-3
BINS = 2000
FOLDS = (0, 1, 3)
ROWS_PER_TASK = 50_000
CUT = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\n\x0b\x0c",
    "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+<=>@[\\]^_`{}~/",
}
CLASS_TABLE = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()} | {"wide": np.arange(256) >= 0x80}
STATISTICS = ("bytes", "words", "word_length", "word_spread", *CLASS_TABLE, "lines", "line_length",
              "new_words", "top_word", "new_lines", "short_words", "long_words")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x len(STATISTICS)"""
    n = np.diff(offsets).astype(np.float64)
    rows = len(n)
    at_least = np.maximum(n, 1)

    def per_row(indicator: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(indicator, dtype=np.float64)])
        return total[edges[1:]] - total[edges[:-1]]

    w = words(data, offsets)
    count = np.diff(w.row_first).astype(np.float64)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = per_row(length, w.row_first) / some
    spread = np.sqrt(np.maximum(per_row(length ** 2, w.row_first) / some - mean ** 2, 0))

    hashes, row = word_hashes(w), w.row
    value, of = distinct_by_row(hashes, row)
    new_words = np.bincount(of, minlength=rows) / some
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate([first, [len(h)]]))
    top = np.zeros(rows)
    np.maximum.at(top, r[first], run)

    breaks = np.flatnonzero(data == 0x0A)
    ends = np.unique(np.concatenate([breaks, offsets[1:]]))
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = ends[np.searchsorted(ends, starts, "left")] if len(starts) else starts
    filled = ends > starts
    starts, ends = starts[filled], ends[filled]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(line_row, minlength=rows).astype(np.float64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    _, line_of = distinct_by_row(hash_spans(padded, starts, ends), line_row)
    new_lines = np.bincount(line_of, minlength=rows) / np.maximum(lines, 1)

    columns = [np.log1p(n), np.log1p(count), mean, spread]
    columns += [per_row(table[data], offsets) / at_least for table in CLASS_TABLE.values()]
    columns += [np.log1p(lines), np.log1p(n / np.maximum(lines, 1)), new_words, top / some, new_lines,
                per_row(length <= 2, w.row_first) / some, per_row(length >= 12, w.row_first) / some]
    return np.stack(columns, axis=1).astype(np.float32) if rows else np.zeros((0, len(STATISTICS)), np.float32)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float32())
    for batch in batches:
        parts = [statistics(data, offsets) for _, data, offsets in chunks(*buffers(batch.column(1)))]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)
        values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values.cast(kind)], names=["doc_id", "x"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


@dataclass
class Features:
    """Standardisation and the random Fourier map."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, std: np.ndarray, size: int = FEATURES, seed: int = 5) -> Features:
        rng = np.random.default_rng(seed)
        d = len(mean)
        return cls(mean, 1 / np.where(std > 1e-6, std, np.inf), rng.normal(0, 1 / np.sqrt(d), (d, size)), rng.uniform(0, 2 * np.pi, size))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """rows x (size + 1): the last column is 1."""
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)


def _equations(features: Features) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = features(matrix(batch.column(0))), np.asarray(batch.column(1), dtype=np.float64)
            fold = np.asarray(batch.column(2))
            for k in np.unique(fold):
                own = fold == k
                both = z[own].T @ np.concatenate([z[own], y[own, None]], axis=1)
                sums[int(k)] = sums.get(int(k), 0) + both
        if sums:
            yield _packed(sums)

    return run


def _packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.astype("<f8").tobytes() for s in sums.values()], pa.binary())], names=["fold", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(s, dtype="<f8")
    if sums:
        yield _packed(sums)


def normal_equations(labelled: DataFrame, features: Features, rows: int) -> dict[int, np.ndarray]:
    """fold -> [Z'Z | Z'y], summed in the tasks, then in few tasks, then here."""
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    sums = labelled.select("x", "y", "fold").repartition(tasks).mapInArrow(_equations(features), "fold int, sums binary")
    if tasks > 8:
        sums = sums.repartition(int(np.ceil(np.sqrt(tasks)))).mapInArrow(_added, "fold int, sums binary")
    total: dict[int, np.ndarray] = {}
    for row in sums.toLocalIterator():
        total[row["fold"]] = total.get(row["fold"], 0) + np.frombuffer(row["sums"], dtype="<f8")
    size = len(features.phase) + 1
    return {k: v.reshape(size, size + 1) for k, v in total.items()}


def ridge(equations: list[np.ndarray]) -> np.ndarray:
    """Weights from summed normal equations; the constant is not shrunk."""
    both = sum(equations)
    size = both.shape[0]
    shrink = np.eye(size) * RIDGE * both[-1, -2]
    shrink[-1, -1] = 1e-9
    return np.linalg.solve(both[:, :size] + shrink, both[:, size])


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit of ``total / count``, weighted by ``count``."""
    blocks: list[list[float]] = []
    for n, s in zip(count.tolist(), total.tolist()):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, s1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + s1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), s / n) for n, s, k in blocks]) if blocks else np.zeros(0)


@dataclass
class Model:
    features: Features | None
    weights: np.ndarray
    at: np.ndarray        # raw scores, ascending
    value: np.ndarray     # calibrated scores there

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.features else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0.0, 1.0)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)


def _cross_fitted(features: Features, weights: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, fold = features(matrix(batch.column(0))), np.asarray(batch.column(2))
            raw = np.zeros(len(z))
            for k, w in weights.items():
                raw[fold == k] = z[fold == k] @ w
            yield pa.RecordBatch.from_arrays([pa.array(_bin(raw)), batch.column(1).cast(pa.float64())], names=["bin", "y"])

    return run


def fit(labelled: DataFrame) -> Model:
    """Fit on ``x`` (statistics), ``y`` (0 or 1) and ``fold``."""
    size = len(STATISTICS)
    row = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size)]).first()
    if not row["n"] or not 0 < row["share"] < 1:
        share = 0.5 if not row["n"] else float(row["share"])
        return Model(None, np.zeros(0), np.array([0.0, 1.0]), np.array([share, share]))
    features = Features.draw(np.array([row[f"m{i}"] for i in range(size)]), np.array([row[f"s{i}"] for i in range(size)]))
    equations = normal_equations(labelled, features, row["n"])
    weights = ridge(list(equations.values()))
    others = {k: ridge([e for j, e in equations.items() if j != k] or [equations[k]]) for k in equations}
    bins = (labelled.select("x", "y", "fold").mapInArrow(_cross_fitted(features, others), "bin bigint, y double")
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).toPandas().sort_values("bin"))  # BINS rows at most
    n, s = bins["n"].to_numpy(np.float64), bins["s"].to_numpy(np.float64)
    at = (bins["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
    return Model(features, weights, at, isotonic(n, s))


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def remainder(doc_id: Column, parts: int = 4) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    stats = materialise(narrow.mapInArrow(_statistics, "doc_id bigint, x array<float>"), "quality-statistics")
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 2))
             .groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")))
    labelled = materialise(
        stats.join(known, "doc_id").select("x", "y", remainder(F.col("doc_id")).cast("int").alias("fold")), "quality-labelled")
    model = fit(labelled)
    return stats.mapInArrow(_scored(model), "doc_id bigint, score double").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
