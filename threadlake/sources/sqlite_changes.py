"""Changes of tables in embedded databases as a streaming source.

    spark.dataSource.register(SqliteChanges)
    spark.readStream.format("sqlite_changes").option("path", p).option("table", "part").load()

An offset is, per database, the newest (time, id) seen; a batch holds the rows
behind the last offset up to the newest one, so a row comes again whenever its
time is bumped and never otherwise. A partition is a run of that order. The time
is ``time_updated``, or ``time_created`` where a table has no other. Databases and
tables that are not there (yet) have no offset and start from the beginning when
they appear.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threadlake.sources.sqlite import _plain, connect

SCHEMA = "db string, time_updated long, id string, value string"
BEFORE_ALL = {"time": -(1 << 62), "id": ""}


class Run(InputPartition):
    """Rows behind ``low`` up to ``high``, each (time, id)."""

    def __init__(self, path: str, low: tuple[int, str], high: tuple[int, str]):
        self.path, self.low, self.high = path, low, high


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.table, self.rows = options["table"], int(options.get("rowsPerPartition", 100_000))

    def _time(self, con) -> str | None:
        """The table's time column; None if there is no such table."""
        have = {row[1] for row in con.execute(f'pragma table_info("{self.table}")')}
        return next((c for c in ("time_updated", "time_created") if c in have), None)

    def _between(self, time: str) -> str:
        return f'from "{self.table}" where ({time}, id) > (?, ?) and ({time}, id) <= (?, ?)'

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for path in self.paths:
            if not os.path.exists(path):
                continue
            con = connect(path)
            if time := self._time(con):
                newest = con.execute(f'select {time}, id from "{self.table}" where {time} is not null order by {time} desc, id desc limit 1').fetchone()
                if newest:
                    found[path] = {"time": int(newest[0]), "id": str(newest[1])}
            con.close()
        return found

    def partitions(self, start: dict, end: dict) -> list[Run]:
        out = []
        for path, high in end.items():
            low = start.get(path, BEFORE_ALL)
            if low == high:
                continue
            con = connect(path)
            time = self._time(con)
            place = f"select {time} as t, id, row_number() over (order by {time}, id) as n {self._between(time)}"
            cuts = con.execute(f"select t, id from ({place}) where n % ? = 0 order by t, id", (low["time"], low["id"], high["time"], high["id"], self.rows)).fetchall()
            con.close()
            edges = [(low["time"], low["id"]), *((int(t), str(i)) for t, i in cuts)]
            if edges[-1] != (high["time"], high["id"]):
                edges.append((high["time"], high["id"]))
            out += [Run(path, a, b) for a, b in zip(edges, edges[1:])]
        return out

    def read(self, part: Run) -> Iterator[tuple]:
        con = connect(part.path)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        time = self._time(con)
        found = con.execute(f"select {time}, id, * {self._between(time)} order by {time}, id", (*part.low, *part.high))
        names = [c[0] for c in found.description][2:]
        for at, key, *values in found:
            yield part.path, int(at), str(key), json.dumps(dict(zip(names, map(_plain, values))), ensure_ascii=False)
        con.close()


class SqliteChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options)


def changes(spark: SparkSession, databases: list[str], table: str, rows_per_partition: int = 100_000) -> DataFrame:
    spark.dataSource.register(SqliteChanges)
    return spark.readStream.format("sqlite_changes").option("path", ",".join(databases)).option("table", table).option("rowsPerPartition", str(rows_per_partition)).load()
