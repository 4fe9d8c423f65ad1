"""One reader per agent, and all stores as one table of messages.

A reader turns the stores of one agent into rows of ``MESSAGES``. Readers are
registered by the agent's name, so a new agent or another place for an old one
is one call of ``register``. ``union`` plans the readers of the chosen agents
side by side: what the caller asks for (agents, a date, a project) prunes stores
and files before they are opened and filters rows in each branch, so nothing of
a store that cannot match is read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.sources import databases, log_ranges, transcripts, workspaces
from threadlake.sources.discovery import SOURCES, Store

MESSAGES = "source string, path string, seq long, role string, text string, date string, time_ms long, project string"
COLUMNS = [c.split()[0] for c in MESSAGES.split(", ")]

# Agents whose project folders have both slashes and hyphens written as hyphens.
FOLDED_PROJECTS = ("claude", "pi", "omp", "droid")


@dataclass(frozen=True)
class Asked:
    """What a caller wants of the stores: a date from which on, a project."""

    since: str | None = None
    project: str | None = None


Reader = Callable[[SparkSession, Sequence[Store], Asked], DataFrame]
_readers: dict[str, Reader] = {}


def register(source: str, reader: Reader) -> None:
    _readers[source] = reader


def readers() -> dict[str, Reader]:
    return dict(_readers)


def shaped(rows: DataFrame, source: str) -> DataFrame:
    """Any messages as ``MESSAGES``: what a store does not know is null or empty."""
    have = {
        "source": F.lit(source),
        "date": F.col("date") if "date" in rows.columns else F.coalesce(F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd"), F.lit("")) if "time_ms" in rows.columns else F.lit(""),
        "time_ms": F.col("time_ms") if "time_ms" in rows.columns else F.lit(None),
        "project": F.coalesce("project", F.lit("")) if "project" in rows.columns else F.lit(""),
    }
    kinds = dict(part.split() for part in MESSAGES.split(", "))
    return rows.select(*[have.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in COLUMNS])


def in_project(rows: DataFrame, needle: str) -> DataFrame:
    return rows.filter(T.project_matches(F.col("project"), needle, F.col("source").isin(*FOLDED_PROJECTS)))


def logs(source: str, glob: str = "*.jsonl") -> Reader:
    """Reader of JSON-lines logs. Files last written before the date are not
    opened: none of their lines can be newer."""

    def read(spark: SparkSession, stores: Sequence[Store], asked: Asked) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        if asked.since:
            files = files.option("modifiedAfter", f"{asked.since}T00:00:00").option("timeZone", "UTC")
        listed = files.load([s.path for s in stores]).select(
            F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("path").alias("file")
        )
        whole = listed.select("path", "file", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))
        return shaped(transcripts.messages(transcripts.events(log_ranges.read_lines(whole, source, open_end=True))), source)

    return read


def tables(source: str, read_databases: Callable[[SparkSession, list[str]], DataFrame]) -> Reader:
    """Reader of embedded databases."""

    def read(spark: SparkSession, stores: Sequence[Store], asked: Asked) -> DataFrame:
        return shaped(read_databases(spark, [s.path for s in stores]), source)

    return read


def conversations(read_logs: Reader) -> Reader:
    """Reader of logs whose folder is told beside them."""

    def read(spark: SparkSession, stores: Sequence[Store], asked: Asked) -> DataFrame:
        bases = list(dict.fromkeys(os.path.dirname(s.path.rstrip("/")) for s in stores))
        return workspaces.with_workspace(read_logs(spark, stores, asked), workspaces.workspaces(spark, bases))

    return read


for _name in ("claude", "codex", "pi", "omp", "droid"):
    register(_name, logs(_name))
register("agy", conversations(logs("agy")))
register("opencode", tables("opencode", databases.opencode))
register("openclaw", tables("openclaw", databases.openclaw))
register("hermes", tables("hermes", databases.hermes))


def union(spark: SparkSession, stores: Sequence[Store], source: str = "all", asked: Asked = Asked()) -> DataFrame:
    """The messages of all chosen stores. ValueError if no store is left or an
    agent has no reader."""
    chosen = [s for s in stores if source in ("all", s.source)]
    if not chosen:
        raise ValueError(f"no transcript stores found for source: {source}")
    order = {name: k for k, name in enumerate(SOURCES)}
    branches = []
    for name in sorted({s.source for s in chosen}, key=lambda n: (order.get(n, len(order)), n)):
        if name not in _readers:
            raise ValueError(f"no reader for source: {name}")
        rows = _readers[name](spark, [s for s in chosen if s.source == name], asked)
        branches.append(in_project(rows, asked.project) if asked.project else rows)
    out = branches[0]
    for more in branches[1:]:
        out = out.unionByName(more)
    return out
