"""Connected components of a table of links.

Up to ``SMALL`` counted links, one task merges them by union-find. Beyond that
they are found by alternating stars: each round rewires every node's
larger neighbours to the smallest node it knows (large star), then its smaller
ones (small star), until no link changes. Rows never outnumber links, nothing is
gathered per node, and every round is written to the shared folder, so a lost
executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import materialize


SMALL = 200_000


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], ["node", "label"])


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every linked node; label is its component's smallest node."""
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    mark = _mark(edges)
    if mark[0] <= SMALL:
        return materialize(edges.coalesce(1).mapInArrow(_merge, "node long, label long"), "labels")
    edges = materialize(edges, "links")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.union(least.filter("u <> m")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
