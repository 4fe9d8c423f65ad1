"""Redaction of transcript lines: whole events, or what matches a pattern."""

from __future__ import annotations

import itertools
import json
import os
import re
import shutil
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import TRIM_CLASS

PLACEHOLDER = "[redacted]"
#: Agents whose sessions are logs and nothing else.
LOGS = ("claude", "codex", "droid", "omp", "pi")

_EDGES = re.compile(f"^[{TRIM_CLASS}]+|[{TRIM_CLASS}]+\\Z")
_HALVES = re.compile("[\ud800-\udfff]")

# Keys whose texts are what was said, or what a tool got or gave.
WORDED_KEYS = frozenset(
    (
        "text", "thinking", "output", "stdout", "stderr", "error", "command", "lastPrompt", "title", "summary", "description",
        "input", "arguments", "action", "toolUseResult", "content", "metadata",
    )
)


def parse_drops(spec: str) -> set[int]:
    """Event numbers from a list such as ``3,7-9``."""
    out: set[int] = set()
    for part in (p.strip() for p in spec.split(",") if p.strip()):
        m = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"not an event or a range: {part}")
        out |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
    return out


def redact(node, placeholder: str = PLACEHOLDER):
    """The same structure without its words: a text by itself, in a list or under
    one of ``WORDED_KEYS`` is replaced; ids, types, names and numbers stay."""
    if isinstance(node, str):
        return placeholder
    if isinstance(node, list):
        return [redact(v, placeholder) for v in node]
    if isinstance(node, dict):
        return {k: v if isinstance(v, str) and k not in WORDED_KEYS else redact(v, placeholder) for k, v in node.items()}
    return node


def _places(row: dict, source: str, block: int, is_result: bool):
    """(holder, key) of what an event of a log's row says; block -1 is the row's only one."""
    if source == "codex":
        if isinstance(row.get("payload"), dict):
            yield row, "payload"
        return
    message = row.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    if block < 0 or not isinstance(content, list):
        if content is not None:
            yield message, "content"
    elif block < len(content):
        yield content, block
    if source == "claude" and is_result and "toolUseResult" in row:
        yield row, "toolUseResult"


class Literals:
    """Finds any of some literals, whatever their case, one pattern at a time."""

    def __init__(self, patterns: Iterable[str], placeholder: str = PLACEHOLDER):
        self.needles = [p for p in (_EDGES.sub("", q).lower() for q in patterns) if p]
        self.placeholder, self.hits = placeholder, 0

    def found(self, text: str) -> bool:
        low = text.lower()
        return any(n in low for n in self.needles)

    def cut(self, text: str) -> str:
        """Without its lines that hold a literal; the placeholder if no word is left."""
        if not self.found(text):
            return text
        lines = text.split("\n")
        kept = [line for line in lines if not self.found(line)]
        self.hits += len(lines) - len(kept)
        left = "\n".join(kept)
        return left if _EDGES.sub("", left) else self.placeholder

    def clean(self, node):
        """A structure with all its texts cut and keys that hold a literal renamed."""
        if isinstance(node, str):
            return self.cut(node)
        if isinstance(node, list):
            return [self.clean(v) for v in node]
        if not isinstance(node, dict):
            return node
        out = {}
        for key, value in node.items():
            if self.found(key):
                self.hits += 1
                names = itertools.chain([self.placeholder], (f"{self.placeholder}-{k}" for k in itertools.count(2)))
                key = next(n for n in names if n not in out)
            out[key] = self.clean(value)
        return out


def _written(node) -> str:
    """Compact JSON; halves of characters, which no encoding has, as escapes."""
    text = json.dumps(node, ensure_ascii=False, separators=(",", ":"))
    return _HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def dropped_events(events: DataFrame, drops: DataFrame) -> DataFrame:
    """path, line, block, idx, kind: of numbered events (path, line, block, idx,
    kind, call_id) those that ``drops`` (path, idx) names, and the results of
    calls among them. A number that no event has is an error."""
    named = drops.select("path", "idx").distinct()
    if missing := named.join(events, ["path", "idx"], "left_anti").first():
        raise ValueError(f"no event {missing.idx} in {missing.path}")
    taken = events.join(named, ["path", "idx"], "left_semi")
    calls = taken.filter("kind = 'tool_call' and call_id <> ''").select("path", "call_id").distinct()
    results = events.filter("kind = 'tool_result'").join(calls, ["path", "call_id"], "left_semi")
    return taken.unionByName(results).select("path", "line", "block", "idx", "kind").distinct()


SCRUBBED = "path string, line long, value string, changed boolean, pattern_lines long"


def scrub_lines(lines: DataFrame, drops: DataFrame | None = None, patterns: Iterable[str] = (), source: str = "claude", placeholder: str = PLACEHOLDER) -> DataFrame:
    """Lines (path, line, value) of an agent's logs without dropped events and
    without lines of texts that hold a pattern: a literal, whatever its case.

    ``drops`` has (path, line) and, as from ``dropped_events``, block and kind;
    without a block all that a row says goes. Rows that are no JSON object stay
    and count as not changed; writing back is left to the caller. Sessions in
    databases, and those an agent keeps in several copies, are refused.
    """
    if source not in LOGS:
        raise ValueError(f"sessions of {source} are not kept in logs alone")
    patterns = list(patterns)
    if drops is None and not Literals(patterns).needles:
        raise ValueError("name events to drop or patterns")
    marked = lines.select(F.col("path").cast("string").alias("path"), F.col("line").cast("long").alias("line"), "value")
    if drops is None:
        marked = marked.withColumn("drops", F.lit(None).cast("array<int>"))
    else:
        block = F.coalesce("block", F.lit(-1)) if "block" in drops.columns else F.lit(-1)
        result = F.coalesce(F.col("kind") == "tool_result", F.lit(False)) if "kind" in drops.columns else F.lit(True)
        told = drops.select(F.col("path").cast("string").alias("path"), F.col("line").cast("long").alias("line"), (2 * block + result.cast("int")).cast("int").alias("told"))
        marked = marked.join(told.groupBy("path", "line").agg(F.collect_set("told").alias("drops")), ["path", "line"], "left")

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, line, value, drops in frame[["path", "line", "value", "drops"]].itertuples(index=False):
                literals = Literals(patterns, placeholder)
                try:
                    node = json.loads(value)
                    before = _written(node)
                    if isinstance(node, dict):
                        for told in drops if drops is not None else ():
                            for holder, key in _places(node, source, told // 2, bool(told % 2)):
                                holder[key] = redact(holder[key], placeholder)
                        node = literals.clean(node)
                    after = _written(node)
                except (ValueError, TypeError, RecursionError):
                    before = after = ""
                    literals.hits = 0
                rows.append((path, line, after if after != before else value, after != before, literals.hits))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCRUBBED.split(", ")])

    return marked.mapInPandas(run, SCRUBBED)


def write_back(path: str, scrubbed: DataFrame) -> str:
    """Replace one log file by its scrubbed lines; returns the backup's path.

    One user's file is rewritten here, on the driver: the lines go to a
    temporary file next to it that then takes its place, mode kept, after a copy
    has been put aside. A file with a line that is not JSON is refused.
    """
    lines = [r.value for r in scrubbed.filter(F.col("path") == path).orderBy("line").select("value").toLocalIterator()]
    for line in lines:
        if line.strip():
            json.loads(line)
    backup, fresh = f"{path}.bak", f"{path}.tmp"
    shutil.copy2(path, backup)
    with open(fresh, "w", encoding="utf-8", newline="") as out:
        out.write("\n".join(lines))
    shutil.copymode(path, fresh)
    os.replace(fresh, path)
    return backup


def pattern_lines(texts: DataFrame, pattern: str) -> DataFrame:
    """path, lines: lines of plain texts that match."""
    hits = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(pattern))
    return texts.select("path", F.size(hits).cast("long").alias("lines")).filter("lines > 0")
