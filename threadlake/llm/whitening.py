"""Whitening of embeddings by a two-pass covariance.

1. First pass: exact integer sums of every dimension, so the mean is known as an
   integer and a fraction and no rounding enters it.
2. Second pass: each task centres its rows and sums their outer products by one
   matrix product a batch; ``treeAggregate`` merges the tasks' matrices on the
   executors.
3. The driver takes the eigenvectors of the covariance (LAPACK's symmetric
   solver; a matrix of d x d, whatever the number of rows) and broadcasts the
   projection.
4. Third pass: the covariance of the projected rows themselves, merged the same
   way, gives ``identity_error``; the last pass returns the rows.

Edge cases: rows whose vector is null, holds a null or non-finite entry or has
another length than most are dropped; repeated rows count and are returned each;
a null id stays null. Entries beyond 2^60 after scaling are held there. A
component without variance (eigenvalue zero to double precision) has whitened
null and counts for nothing in ``identity_error``, which is null if no component
has any; explained is null if nothing varies. ``deviation`` is null where it
exceeds a long; ``deviation_exact`` has it in decimal digits always. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlake.llm.vectors import floored, kept_vectors, matrix, per_task, tree_sum
from threadlake.session import bound_batches

SCALE = 64
SHIFT = 1_000_000
MOST = 1 << 60
COMPONENTS = 32

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def _levels(column: pa.Array, length: int) -> np.ndarray:
    return floored(matrix(column, length), SCALE, MOST) + SHIFT


def _sums(vectors: DataFrame, length: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact at any size."""

    def fold(batches: Iterable[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in batches:
            x = _levels(batch.column(0), length)
            rows += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += low >> 32
            low &= 0xFFFFFFFF
        return pa.record_batch([pa.array([rows]), pa.array([high.tolist()]), pa.array([low.tolist()])], ["rows", "high", "low"]) if rows else None

    parts = vectors.mapInArrow(per_task(fold), "rows long, high array<bigint>, low array<bigint>")
    read = lambda r: (r.rows, [(h << 32) + w for h, w in zip(r.high, r.low)])
    return tree_sum(parts, read, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]))


class Centre:
    """The mean S / n as whole part and remainder of every dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 of every row, as exact integers."""
        away = x - self.whole
        reach = (float(np.abs(away).max(initial=0)) + 1.0) * self.n
        if reach * reach * max(1, x.shape[1]) >= 2.0**62:
            away, rest, n = away.astype(object), self.rest.astype(object), int(self.n)
            return ((away * n - rest) ** 2).sum(axis=1).tolist()
        return ((away * self.n - self.rest) ** 2).sum(axis=1).tolist()


def _products(vectors: DataFrame, centre: Centre, length: int, projection: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of outer products, sum) of the centred rows, projected if asked."""
    sent = vectors.sparkSession.sparkContext.broadcast((centre, projection))
    size = length if projection is None else projection.shape[1]

    def fold(batches: Iterable[pa.RecordBatch]) -> pa.RecordBatch | None:
        mean, onto = sent.value
        product, total, rows = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            x = mean.centred(_levels(batch.column(0), length))
            x = x if onto is None else x @ onto
            product += x.T @ x
            total += x.sum(axis=0)
            rows += len(x)
        return pa.record_batch([pa.array([product.tobytes()]), pa.array([total.tobytes()])], ["product", "total"]) if rows else None

    read = lambda r: (np.frombuffer(r.product).reshape(size, size), np.frombuffer(r.total))
    return tree_sum(vectors.mapInArrow(per_task(fold), "product binary, total binary"), read, lambda a, b: (a[0] + b[0], a[1] + b[1]))


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row that counts and each of the first ``components``
    components: vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_exact."""
    spark = rows.sparkSession
    bound_batches(spark)
    kept, length = kept_vectors(rows, id_col, vector_col)
    vectors = kept.select("vector")
    summed = _sums(vectors, length) if length else None
    if summed is None:
        return spark.createDataFrame([], RESULT)
    centre = Centre(*summed)
    covariance = _products(vectors, centre, length)[0] / centre.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    first = min(components, length)
    values, axes = values[::-1][:first], axes[:, ::-1][:, :first]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(first)] < 0, -1.0, 1.0)
    spread = float(np.trace(covariance))
    varies = values > max(0.0, values[0]) * length * np.finfo(float).eps * 4
    projection = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    error = None
    if varies.any():
        product, total = _products(vectors, centre, length, projection[:, varies])
        mean = total / centre.n
        error = float(np.abs(product / centre.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    explained = [max(0.0, float(v)) / spread if spread > 0 else None for v in values]
    sent = spark.sparkContext.broadcast((centre, projection))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, onto = sent.value
        for batch in batches:
            x = _levels(batch.column(1), length)
            count = len(x)
            away = mean.deviations(x)
            white = (mean.centred(x) @ onto).ravel()
            dead = np.tile(~varies, count)
            each = np.repeat(np.arange(count), first)
            exact = pa.array([str(a) for a in away], pa.string())
            fits = pa.array([a if a < 1 << 63 else None for a in away], pa.int64())
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, first + 1, dtype=np.int32), count)),
                    pa.array(np.full(len(each), mean.n, dtype=np.int64)),
                    fits.take(pa.array(each)),
                    pa.array(white, mask=dead),
                    pa.array(explained * count, pa.float64()),
                    pa.array([error] * len(each), pa.float64()),
                    exact.take(pa.array(each)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return kept.select("vec_id", "vector").mapInArrow(project, RESULT)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
