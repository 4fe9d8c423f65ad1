"""A trigram index of messages that is kept between queries.

``postings/batch=B/bucket=K`` holds (trigram, path, seq), sorted by trigram, where
K is a hash of the trigram; ``manifest`` (see ``versions``) names the batches that
count and the layout they were written in. A lookup reads the buckets of its
trigrams alone. ``sync`` brings an index up to date: batches that it lacks are
added, those that are no longer there leave the manifest, and an index of
another layout is built anew.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import search
from threadlake.streaming.versions import Versions, delete, names

LAYOUT = 1
BUCKETS = 64
MANIFEST = "batch string, layout int"


def bucket_of(trigram: str) -> int:
    return zlib.crc32(trigram.encode()) % BUCKETS


class StoredIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Versions(spark, f"{self.root}/manifest", MANIFEST)

    def batches(self) -> list[str]:
        """Batches that count; none of another layout do."""
        rows = self.manifest.read().collect()  # one row a batch
        return sorted(r.batch for r in rows) if all(r.layout == LAYOUT for r in rows) else []

    def sync(self, messages: DataFrame, batches: list[str]) -> list[str]:
        """Index the rows (batch, path, seq, text) of the named batches that are
        not in yet; the batches added."""
        version, have = self.manifest.newest(), self.batches()
        missing = sorted(set(batches) - set(have))
        if not missing and set(have) == set(batches):
            return []
        for batch in missing:
            grams = search.trigram_index(messages.filter(F.col("batch") == batch))
            grams = grams.withColumn("bucket", (F.crc32(F.col("trigram").cast("binary")) % BUCKETS).cast("int"))
            # By range a task writes the few buckets of its own, not a file in each.
            spread = grams.repartitionByRange("bucket", "trigram").sortWithinPartitions("bucket", "trigram")
            spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/batch={batch}")
        self.manifest.publish(self.spark.createDataFrame([(b, LAYOUT) for b in sorted(batches)], MANIFEST), version)
        return missing

    def postings(self, grams: list[str]) -> DataFrame:
        """batch, trigram, path, seq of the given trigrams."""
        have = self.batches()
        rows = self.spark.read.option("basePath", f"{self.root}/postings").parquet(*[f"{self.root}/postings/batch={b}" for b in have])
        wanted = sorted({bucket_of(g) for g in grams})
        return rows.filter(F.col("bucket").isin(wanted) & F.col("trigram").isin(*grams)).select(F.col("batch").cast("string").alias("batch"), "trigram", "path", "seq")

    def met(self, term: str) -> DataFrame | None:
        """(path, seq) of the rows that hold every trigram of a term; None if the
        term is too short to have one."""
        low = term.lower()
        grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        if not grams:
            return None
        if not self.batches():
            return self.spark.createDataFrame([], "path string, seq long")
        found = self.postings(grams).groupBy("batch", "path", "seq").agg(F.count("*").alias("n"))
        return found.filter(F.col("n") == len(grams)).select("path", "seq").distinct()

    def rank(self, messages: DataFrame, term: str, limit: int = 10) -> DataFrame:
        """``search.rank`` over the rows that the index names; short terms scan."""
        met = self.met(term)
        return search.rank(messages if met is None else messages.join(met, ["path", "seq"], "left_semi"), term, limit)

    def vacuum(self) -> None:
        """Delete the postings of batches that no longer count."""
        have = {f"batch={b}" for b in self.batches()}
        for name in names(self.spark, f"{self.root}/postings"):
            if name.startswith("batch=") and name not in have:
                delete(self.spark, f"{self.root}/postings/{name}")
        self.manifest.vacuum()


def of_table(spark: SparkSession, table: str) -> StoredIndex:
    """The index of a refreshed messages table, brought up to date: each refresh
    is a batch of it. Rows that a later batch replaced stay in their postings
    and fall away where they meet the table."""
    from threadlake.streaming import refresh

    live = [r.batch for r in refresh.known_files(spark, table).select(F.explode("batches").alias("batch")).distinct().collect()]  # one row a refresh
    kept = StoredIndex(spark, f"{table}/trigrams")
    if live or kept.batches():
        rows = spark.read.schema(refresh.MESSAGES).parquet(f"{table}/messages") if live else spark.createDataFrame([], refresh.MESSAGES)
        kept.sync(rows, live)
    return kept


def of_files(spark: SparkSession, messages: DataFrame, path: str, root: str) -> StoredIndex:
    """The index of messages read from ``path``, kept below ``root``: built when
    it is first asked for and when the files are other ones."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mark = listed.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    batch = f"{zlib.crc32(repr(tuple(mark)).encode()):08x}"
    kept = StoredIndex(spark, f"{root}/{zlib.crc32(path.encode()):08x}")
    kept.sync(messages.withColumn("batch", F.lit(batch)), [batch])
    return kept
