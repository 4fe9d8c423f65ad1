"""Compression of vectors to codes, nearest entries by segment-mean lower bounds.

Vectors become integers, are cut into ``PARTS`` consecutive parts, and every part
is coded by the nearest entry of its position's codebook, which two rounds of
assignment and averaging refine.

The nearest entry is found from coarse to fine. At a level a part and an entry
are cut into blocks; with s the sum of a block of L components and r the norm of
what is left beside its mean, the squared distance is at least the sum over
blocks of ``((s - s')^2 + (r - r')^2) / L``, where r^2 counts L times. The level
of one block is taken for all entries; the entry of the least bound gives an
upper bound by its exact distance, and entries whose lower bound exceeds it go.
Each further level halves the blocks and looks at the survivors only; those left
receive exact integer distances. Bounds are lowered by more than floating point
can err, so no nearest entry is ever lost; ties go to the lower index.

A round is one pass over the table: a task sums its parts by entry, Spark adds
the sums up by entry, and the driver receives 64 x d sums at any size.

Edge cases: rows whose vector is null, holds a null or non-finite component or
has another length than most are dropped. Lengths that ``PARTS`` does not divide
are filled up with zeros at the end. Fewer kept rows than entries make a smaller
codebook. Null ids come last for the codebook and equal ids by their vectors;
repeated rows are coded each. Components beyond 2^52 after scaling are held
there. error and label_error are null where they exceed a long. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.vectors import floored, kept_vectors, matrix
from threadlake.session import bound_batches, concluded, materialize

SCALE = 256
MOST = 1 << 52
PARTS = 16
ENTRIES = 64
ROUNDS = 2
MAX_BROADCAST_LABELS = 1_000_000
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string, label string"


def _cut(column: pa.Array, length: int) -> np.ndarray:
    """Rows x parts x components of the integers."""
    x = floored(matrix(column, length), SCALE, MOST)
    if more := -length % PARTS:
        x = np.pad(x, ((0, 0), (0, more)))
    return x.reshape(len(x), PARTS, -1)


def _blocks(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row cut into k blocks: lengths, sums, norms beside the mean (times root of length)."""
    edges = np.linspace(0, x.shape[1], k + 1).astype(int)
    size = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1).astype(np.float64)
    square = np.add.reduceat(x.astype(np.float64) ** 2, edges[:-1], axis=1)
    return size.astype(np.float64), total, np.sqrt(np.maximum(0.0, size * square - total**2))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every row of ``x``."""
    if x.shape[1] * (2 * max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0)))) ** 2 >= 2.0**52:
        # Beyond what doubles and longs hold exactly: the same distances in whole numbers.
        away = ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
        best = np.array([min(range(len(row)), key=row.__getitem__) for row in away], dtype=np.int64)
        return best, away[np.arange(len(x)), best]
    size, s, r = _blocks(x, 1)
    _, t, q = _blocks(entries, 1)
    bound = ((s - t.T) ** 2 + (r - q.T) ** 2) / size[0]
    guess = bound.argmin(axis=1)
    upper = ((x - entries[guess]) ** 2).sum(axis=1)
    # What rounding may add to a bound, generously.
    slack = 1e-9 * ((x.astype(np.float64) ** 2).sum(axis=1) + float((entries.astype(np.float64) ** 2).sum(axis=1).max()) + 1.0)
    limit = upper + slack
    row, entry = np.nonzero(bound <= limit[:, None])
    k = 2
    while k < x.shape[1]:
        size, s, r = _blocks(x, k)
        _, t, q = _blocks(entries, k)
        finer = (((s[row] - t[entry]) ** 2 + (r[row] - q[entry]) ** 2) / size).sum(axis=1)
        left = finer <= limit[row]
        row, entry = row[left], entry[left]
        k *= 2
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(exact, starts) if len(x) else exact
    hits = np.flatnonzero(exact == least[row])  # ascending by row, then entry
    return entry[hits[np.searchsorted(row[hits], np.arange(len(x)))]], least


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distance over all parts) of every row."""
    found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def _refined(vectors: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """Every entry replaced by the floored mean of the parts nearest to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    entries, width = books.shape[1:]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        high = np.zeros_like(total)
        for batch in batches:
            x = _cut(batch.column(0), length)
            for p in range(PARTS):
                code = nearest(x[:, p], sent.value[p])[0]
                np.add.at(total[p], code, x[:, p] & 0xFFFFFFFF)
                np.add.at(high[p], code, x[:, p] >> 32)
                np.add.at(count[p], code, 1)
            high += total >> 32
            total &= 0xFFFFFFFF
        part, entry = np.nonzero(count)
        if len(part):
            flat = lambda a: pa.array(a[part, entry].reshape(-1))
            each = lambda a: pa.array(np.repeat(a, width))
            place = pa.array(np.tile(np.arange(width), len(part)))
            yield pa.record_batch([each(part), each(entry), place, flat(high), flat(total), each(count[part, entry])], ["part", "entry", "place", "high", "low", "k"])

    made = vectors.mapInArrow(sums, "part long, entry long, place long, high long, low long, k long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    grouped = made.groupBy("part", "entry", "place").agg(whole("high").alias("high"), whole("low").alias("low"), F.sum("k").alias("k"))
    fresh = books.copy()
    for part, entry, place, high, low, k in grouped.collect():  # one row a component of the codebooks
        fresh[part, entry, place] = ((int(high) << 32) + int(low)) // k
    return fresh


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of every row that counts."""
    spark = rows.sparkSession
    bound_batches(spark)
    kept, length = kept_vectors(rows, id_col, vector_col, F.col(label_col).cast("string").alias("label"))
    if not length:
        return spark.createDataFrame([], RESULT)
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()
    start = _cut(pa.array([r.vector for r in seeds], pa.list_(pa.float64())), length)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(ROUNDS):
        books = _refined(kept.select("vector"), books, length)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, away = _assigned(_cut(batch.column(1), length), sent.value)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(text, pa.string()), pa.array([str(e) for e in away.tolist()], pa.string())], ["vec_id", "label", "code", "exact"])

    def build() -> DataFrame:
        coded = kept.select("vec_id", "vector", "label").mapInArrow(code, "vec_id long, label string, code string, exact string")
        coded = materialize(coded.withColumn("exact", F.col("exact").cast("decimal(38,0)")), "vector-codes")
        labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum("exact").alias("all"))
        if (labels := materialize(labels, "vector-labels")).count() <= MAX_BROADCAST_LABELS:
            labels = F.broadcast(labels)
        joined = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
        return joined.select("vec_id", "code", F.expr("try_cast(exact as long)").alias("error"), F.expr("try_cast(all as long)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"), "label")

    return concluded(spark, "vector-result", build)


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _round_sql(k: int) -> str:
    return f"""
a{k} AS (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c USING (part))
  GROUP BY vec_id, part
)"""


def _means_sql(k: int) -> str:
    return f"""
m{k} AS (
  SELECT part, entry, list(v ORDER BY place) AS x
  FROM (SELECT a.part, a.entry, i.place, floor(sum(p.x[i.place])::DOUBLE / count(*))::BIGINT AS v
        FROM a{k} a JOIN p USING (vec_id, part), (SELECT unnest(range(1, len((SELECT any_value(x) FROM p)) + 1)) AS place) i GROUP BY ALL)
  GROUP BY part, entry
),
c{k + 1} AS (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""


OP12_SQL = (
    """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)))
),
p AS (SELECT vec_id, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x FROM e, (SELECT unnest(range(16)) AS part)),
c0 AS (
  SELECT part, r - 1 AS entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM e QUALIFY r <= 64) USING (vec_id)
),"""
    + _round_sql(0) + "," + _means_sql(0) + "," + _round_sql(1) + "," + _means_sql(1) + "," + _round_sql(2)
    + """,
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT f.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY e.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM f JOIN e USING (vec_id)
"""
)
