"""Embedded databases as a Spark data source: one row of JSON per table row.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", p).option("table", "message").load()

Databases are opened read-only and, where no other process can be writing,
immutable; a missing table gives no rows. A partition is a range of rowids.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "db string, tbl string, row_id long, value string"


def connect(path: str) -> sqlite3.Connection:
    still = os.path.exists(path + "-wal") and not os.path.exists(path + "-shm")
    return sqlite3.connect(f"file:{path}?mode=ro{'&immutable=1' if still else ''}", uri=True)


def _plain(value):
    if isinstance(value, bytes):
        if value[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            value = zstandard.ZstdDecompressor().decompressobj().decompress(value)
        return value.decode("utf-8", "replace")
    return value


class Span(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.table, self.rows = options["table"], int(options.get("rowsPerPartition", 100_000))

    def _exists(self, con) -> bool:
        return con.execute("select 1 from sqlite_master where type in ('table', 'view') and name = ?", (self.table,)).fetchone() is not None

    def partitions(self) -> list[Span]:
        out = []
        for path in self.paths:
            con = connect(path)
            if self._exists(con):
                low, high = con.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
                if low is not None:
                    out += [Span(path, k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]
            con.close()
        return out or [Span("", 0, -1)]

    def read(self, part: Span) -> Iterator[tuple]:
        if not part.path:
            return
        con = connect(part.path)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        rows = con.execute(f'select rowid, * from "{self.table}" where rowid between ? and ? order by rowid', (part.low, part.high))
        names = [c[0] for c in rows.description][1:]
        for row_id, *values in rows:
            try:
                yield part.path, self.table, row_id, json.dumps(dict(zip(names, map(_plain, values))), ensure_ascii=False)
            except Exception:  # a frame that does not decode drops its own row only
                continue
        con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def read_table(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", ",".join(paths)).option("table", table).load()
