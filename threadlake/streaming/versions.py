"""Tables of numbered versions, published one at a time.

A version is a folder written under a name of its own; it counts once a marker
``published/N`` names it. The marker is created only if it is not there yet, so of
two writers of the same number one fails, and a writer that dies leaves a folder
that no marker names: the next one is not held up by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class AlreadyPublished(RuntimeError):
    """Another writer has published this version."""


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, sorted; none if it is not there."""
    place, store = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


class Versions:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def newest(self) -> int:
        return max((int(n) for n in names(self.spark, f"{self.root}/published") if n.isdigit()), default=0)

    def folder(self, number: int) -> str:
        place, store = _place(self.spark, f"{self.root}/published/{number:06d}")
        stream = store.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame:
        number = self.newest() if number is None else number
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self.folder(number)}")

    def publish(self, rows: DataFrame, after: int) -> int:
        """Write the version that follows ``after`` and make it count."""
        name, number = f"rows-{uuid.uuid4().hex}", after + 1
        rows.write.parquet(f"{self.root}/{name}")
        place, store = _place(self.spark, f"{self.root}/published/{number:06d}")
        try:
            stream = store.create(place, False)
        except Exception as fault:
            if store.exists(place):
                raise AlreadyPublished(f"version {number} of {self.root}") from fault
            raise
        stream.write(bytearray(name.encode()))
        stream.close()
        return number

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the newest ``keep`` versions and folders that no marker
        names; the folders kept. Not while another writer is at work."""
        kept = [n for n in range(max(1, self.newest() - keep + 1), self.newest() + 1)]
        folders = {self.folder(n) for n in kept}
        for name in names(self.spark, f"{self.root}/published"):
            if name.isdigit() and int(name) not in kept:
                delete(self.spark, f"{self.root}/published/{name}")
        for name in names(self.spark, self.root):
            if name.startswith("rows-") and name not in folders:
                delete(self.spark, f"{self.root}/{name}")
        return sorted(folders)
