"""What the vector operators share: which rows count, and lists as matrices.

A row counts if its vector is there, holds no null, NaN or infinite entry, and
has the length that most such vectors have (ties: the longer one); a vector of
another length fits no matrix and is dropped like a missing one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, *others: str) -> tuple[DataFrame, int]:
    """((id, vector as doubles, others) of the rows that count, vector length);
    length 0 if there are none."""
    vector = F.col(vector_col).cast("array<double>")
    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), *others)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = slim.filter(F.col("vector").isNotNull() & finite)
    most = fine.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else 0
    return fine.filter(F.size("vector") == length), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of equal lists, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def floored(values: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * value) as long, held within ``most`` on either side."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -most, most).astype(np.int64)


def tree_sum(parts: DataFrame, read: Callable[[Any], Any], add: Callable[[Any, Any], Any]) -> Any:
    """The tasks' partial results merged in a tree on the executors; the driver
    receives one value of the size of a part, None if there is none."""

    def both(x: Any, y: Any) -> Any:
        return y if x is None else x if y is None else add(x, y)

    return parts.rdd.map(read).treeAggregate(None, both, both)


def per_task(fold: Callable[[Iterable[pa.RecordBatch]], pa.RecordBatch | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: one row a task, none from a task without rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (made := fold(batches)) is not None:
            yield made

    return run
