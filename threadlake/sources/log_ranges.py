"""Byte ranges of logs that grow, read by tasks.

A log is never one row: it is cut into ranges of ``RANGE_BYTES`` and a task reads
the lines that begin in its range, the last one to its end. Only complete lines
count; what stands behind the last newline is still being written. A line is
named by the byte it begins at, a number that later appends leave alone.

``surveyed`` looks at the first and last bytes of each log only: whether its
head is the one known (then what was read stays and the tail follows) and where
its last line ends. Files are opened through ``pyarrow.fs``, so any store it
knows will do; one that cannot be read is reported, not fatal.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 4096
RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20

SURVEY = "path string, file string, size long, mtime_ms long, action string, start long, stop long, head string, head_bytes long, error string"
LINES = "path string, source string, line long, value string"


def _open(uri: str):
    scheme, _, rest = uri.partition(":")  # names are as Spark writes them, blanks and all
    store, path = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(quote(uri, safe=":/@?=&%"))
    return io.BufferedReader(store.open_input_file(path), 1 << 20)


def _line_end(log, start: int, size: int, step: int = 1 << 16) -> int:
    """The byte behind the last newline between ``start`` and ``size``; ``start`` if there is none."""
    at = size
    while at > start:
        low = max(start, at - step)
        log.seek(low)
        if (found := log.read(at - low).rfind(b"\n")) >= 0:
            return low + found + 1
        at = low
    return start


def _surveyed(row: dict) -> dict:
    out = {k: row[k] for k in ("path", "file", "size", "mtime_ms")} | {"start": 0, "stop": 0, "head": "", "head_bytes": 0, "error": None}
    try:
        with _open(row["file"]) as log:
            size = min(row["size"], log.seek(0, 2))
            log.seek(0)
            first = log.read(min(max(HEAD_BYTES, row["known_head_bytes"] or 0), size))
            known = row["known_head_bytes"]
            grown = known is not None and row["consumed"] <= size and row["known_size"] <= row["size"] and hashlib.sha256(first[:known]).hexdigest() == row["known_head"]
            if grown:
                out |= {"action": "grown", "start": row["consumed"], "head": row["known_head"], "head_bytes": known}
            else:
                head = first[:HEAD_BYTES]
                out |= {"action": "new" if known is None else "rewritten", "head": hashlib.sha256(head).hexdigest(), "head_bytes": len(head)}
            out["stop"] = _line_end(log, out["start"], size)
    except OSError as fault:  # gone or closed to us since it was listed
        out |= {"action": "skipped", "error": str(fault)[:300]}
    return out


def surveyed(wanted: DataFrame) -> DataFrame:
    """What to read of each log: (path, file, size, mtime_ms) and, of a known one,
    known_size, consumed, known_head, known_head_bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_surveyed(row) for row in batch.to_pylist()]
            names = [c.split()[0] for c in SURVEY.split(", ")]
            kinds = {"size": pa.int64(), "mtime_ms": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "head_bytes": pa.int64()}
            yield pa.record_batch([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return wanted.mapInArrow(run, SURVEY)


def _lines(uri: str, low: int, high: int, start: int, stop: int, open_end: bool) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that begin in [low, high) of the part [start, stop)."""
    with _open(uri) as log:
        at = low
        if low > start:  # the line before this range belongs to the one before
            log.seek(low - 1)
            skipped = log.readline()
            at = low - 1 + len(skipped)
        else:
            log.seek(low)
        while at < high and at < stop:
            line = log.readline()
            if not line or not (open_end or line.endswith(b"\n")):
                return
            yield at, line
            at += len(line)


def read_lines(survey: DataFrame, source: str, range_bytes: int | None = None, open_end: bool = False) -> DataFrame:
    """path, source, line, value of the complete lines in the given parts (path,
    file, start, stop) of logs; with ``open_end`` also of a last line without its
    newline."""
    size = range_bytes or RANGE_BYTES
    parts = survey.filter("stop > start").select(
        "path", "file", "start", "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(size).cast("long"))).alias("low")
    )
    parts = parts.withColumn("high", F.least(F.col("low") + size, F.col("stop")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []
        weight = 0

        def made() -> pa.RecordBatch:
            paths, lines, values = zip(*held)
            return pa.record_batch([pa.array(paths), pa.array([source] * len(held)), pa.array(lines, pa.int64()), pa.array(values)], ["path", "source", "line", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                for at, line in _lines(row["file"], row["low"], row["high"], row["start"], row["stop"], open_end):
                    text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                    held.append((row["path"], at, text.removeprefix("﻿") if at == 0 else text))
                    weight += len(line)
                    if weight >= BATCH_BYTES:
                        yield made()
                        held, weight = [], 0
        if held:
            yield made()

    # spread by range: neighbours of one log go to different tasks
    return parts.repartition(F.xxhash64("path", "low")).mapInArrow(run, LINES)
