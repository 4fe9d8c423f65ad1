"""Session logs of coding agents, read leniently into one shape.

Lines are JSON of several layouts. A field of the wrong type reads as absent, a
repeated key as its last value, a line that is not JSON is skipped but counted,
and half surrogate pairs become U+FFFD. That is not what SQL's JSON functions
do, so lines are parsed in one vectorized Python step; everything after it is
DataFrame code.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = (
    "path string, line long, block int, node_id string, parent_id string, kind string, role string, text string, tool string, "
    "input string, call_id string, output string, is_error boolean, ts string, project string, place string"
)
#: Where a row stands if not in the tree of messages as any other: ``hook`` rows
#: are never the newest message, ``aside`` rows have no parent and always stay.
HOOK, ASIDE = "hook", "aside"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def raw_lines(spark: SparkSession, root: str | list[str], source: str, glob: str = "*.jsonl") -> DataFrame:
    """path, source, line, value: every line of every log below a folder, or of
    the given files."""
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    named = whole.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = named.select("path", F.posexplode(F.split("value", "\r?\n", -1)).alias("pos", "value"))
    return lines.select("path", F.lit(source).alias("source"), (F.col("pos") + 1).cast("long").alias("line"), "value")


def _string(node, *keys) -> str | None:
    for key in keys:
        node = node.get(key) if isinstance(node, dict) else None
    return node if isinstance(node, str) else None


def _flat(content) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        parts = [p if isinstance(p, str) else _string(p, "text") for p in content]
        return " ".join(p for p in parts if p)
    return ""


def _blocks(row: dict, message: dict, base: dict) -> list[dict]:
    """Claude, Droid and Pi shaped messages."""
    role, content = _string(message, "role"), message.get("content")
    if role == "toolResult":
        return [base | {"kind": "tool_result", "role": role, "call_id": _string(message, "toolCallId"), "output": _flat(content), "is_error": message.get("isError") is True}]
    if role not in ("user", "assistant"):
        return []
    blocks = [{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []
    out = []
    for k, block in enumerate(b for b in blocks if isinstance(b, dict)):
        kind = _string(block, "type")
        here = base | {"block": k, "role": role}
        if kind == "text" and _string(block, "text"):
            out.append(here | {"kind": role, "text": block["text"]})
        elif kind == "thinking" and _string(block, "thinking"):
            out.append(here | {"kind": "thinking", "text": block["thinking"]})
        elif kind in ("tool_use", "toolCall"):
            payload = block.get("input", block.get("arguments"))
            out.append(here | {"kind": "tool_call", "tool": _string(block, "name"), "call_id": _string(block, "id"), "input": payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)})
        elif kind == "tool_result":
            out.append(here | {"kind": "tool_result", "call_id": _string(block, "tool_use_id"), "output": _flat(block.get("content")), "is_error": block.get("is_error") is True})
    return out


def compaction_summary(source: str, row: dict) -> str | None:
    """What a row that stands for earlier messages says, as a user's message."""
    kind, removed = _string(row, "type"), None
    if source == "droid" and kind == "compaction_state" and _string(row, "summaryKind") == "llm_summary":
        text, removed = _string(row, "summaryText"), row.get("removedCount")
    elif source == "codex" and kind == "compacted":
        text = _string(row, "payload", "message")
    else:
        return None
    if not text or not text.strip():
        return None
    counted = isinstance(removed, (int, float)) and not isinstance(removed, bool) and removed >= 1
    return f"[Compaction summary{f' of {removed:g} earlier messages' if counted else ''}]\n\n{text}"


def _typed_by_user(text: str) -> str:
    """A user's own words: a block of the harness has none, one appended is cut."""
    if text.lstrip().startswith(("<system-reminder>", "<system-notification>")):
        return ""
    return re.split(r"\s*\n<system-notification>", text, maxsplit=1)[0]


def parse_line(source: str, value: str) -> list[dict]:
    """The events of one line; none if it is no JSON object or holds no event."""
    try:
        row = json.loads(value)
    except (ValueError, RecursionError):
        return []
    if not isinstance(row, dict):
        return []
    kind = _string(row, "type")
    base = {
        "node_id": _string(row, "uuid") or _string(row, "id"),
        "parent_id": next((row[k] for k in ("parentUuid", "parentId") if isinstance(row.get(k), str)), _string(row, "logicalParentUuid")),
        "ts": _string(row, "timestamp") or _string(row, "created_at"),
        "project": _string(row, "cwd") or _string(row, "payload", "cwd"),
    }
    if (summary := compaction_summary(source, row)) is not None:
        return [base | {"node_id": None, "parent_id": None, "kind": "user", "role": "user", "text": summary, "place": ASIDE}]
    if source == "codex":
        payload = row.get("payload") if isinstance(row.get("payload"), dict) else {}
        what = _string(payload, "type")
        if kind != "response_item":
            return [base | {"kind": "meta"}] if base["project"] else []
        if what == "message" and _string(payload, "role") in ("user", "assistant"):
            return [base | {"kind": payload["role"], "role": payload["role"], "text": _flat(payload.get("content"))}]
        if what in ("function_call", "custom_tool_call"):
            return [base | {"kind": "tool_call", "tool": _string(payload, "name"), "call_id": _string(payload, "call_id"), "input": _string(payload, "arguments") or _string(payload, "input")}]
        if what in ("function_call_output", "custom_tool_call_output"):
            output = _string(payload, "output") or ""
            failed = re.match(r"(?i)\s*(Script failed|Error:|Process exited with code [1-9]|Exit code: [1-9])", output)
            return [base | {"kind": "tool_result", "call_id": _string(payload, "call_id"), "output": output, "is_error": bool(failed)}]
        return []
    if source == "agy":
        text = _string(row, "content") or ""
        if kind == "USER_INPUT":
            inner = re.search(r"<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", text, re.S)
            return [base | {"kind": "user", "role": "user", "text": inner[1] if inner else text}]
        if kind == "PLANNER_RESPONSE":
            calls = [c for c in row.get("tool_calls") or [] if isinstance(c, dict)]
            said = [base | {"kind": "assistant", "role": "assistant", "text": text}] if text else []
            return said + [base | {"kind": "tool_call", "block": k, "tool": _string(c, "name"), "input": json.dumps(c.get("args"), ensure_ascii=False)} for k, c in enumerate(calls)]
        return [base | {"kind": "tool_result", "output": text, "is_error": kind == "ERROR_MESSAGE"}] if kind else []
    message = row.get("message") if isinstance(row.get("message"), dict) else None
    if source == "droid":
        if kind != "message":  # bookkeeping is no part of the tree
            return [base | {"node_id": None, "parent_id": None, "kind": "meta", "place": ASIDE}] if base["project"] else []
        base["place"] = HOOK if _string(row, "hookEventName") else None
        if message is None or _string(row, "visibility") == "llm_only":
            return [base | {"kind": "meta"}]  # not shown, though others hang on it
    if message is None or (source == "claude" and kind not in ("user", "assistant")):
        return [base | {"kind": "meta"}] if base["project"] or base["node_id"] else []
    found = _blocks(row, message, base)
    if source == "droid":
        for event in found:
            if event["kind"] == "user":
                event["text"] = _typed_by_user(event["text"])
        found = [e for e in found if e["kind"] != "user" or e["text"].strip()]
    return found or [base | {"kind": "meta"}]


def events(lines: DataFrame) -> DataFrame:
    """The events of raw lines, one row per block."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, source, line, value in frame[["path", "source", "line", "value"]].itertuples(index=False):
                for event in parse_line(source, value or ""):
                    rows.append([path, line, *((v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v := event.get(c), str) else v) for c in _NAMES[2:])])
            out = pd.DataFrame(rows, columns=_NAMES)
            out["block"] = out["block"].astype("Int32")
            out["is_error"] = out["is_error"].astype("boolean")
            yield out

    return lines.filter(F.trim("value") != "").mapInPandas(run, EVENTS)


def active_branch(rows: DataFrame) -> DataFrame:
    """Rows (path, line, node_id, parent_id, ...) on the path from each session's
    newest node to its root, and those that stand aside of the tree; rows without
    an id stay if the session has no tree.

    A walk along parent links is sequential, but sessions are many: each is walked
    on its own, by its links alone, which say what lines to keep. A link to the
    newest earlier row of that id wins; cycles end the walk.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame.sort_values("line", kind="stable").drop_duplicates("line")
        lines, ids, parents, places = (nodes[c].tolist() for c in ("line", "node_id", "parent_id", "place"))
        where: dict[str, list[int]] = {}
        for k, name in enumerate(ids):
            if isinstance(name, str):
                where.setdefault(name, []).append(k)
        if not where:
            return nodes[["path", "line"]]
        at = next((k for k in reversed(range(len(ids))) if isinstance(ids[k], str) and places[k] != HOOK), None)
        keep = {line for line, place in zip(lines, places) if place == ASIDE}
        while at is not None:
            keep.add(lines[at])
            same = where.get(parents[at], []) if isinstance(parents[at], str) else []
            before = bisect.bisect_left(same, at)  # always an earlier row, so the walk ends
            at = same[before - 1] if before else None
        return nodes.loc[nodes["line"].isin(keep), ["path", "line"]]

    place = F.col("place") if "place" in rows.columns else F.lit(None).cast("string").alias("place")
    kept = rows.select("path", "line", "node_id", "parent_id", place).groupBy("path").applyInPandas(walk, "path string, line long")
    return rows.join(kept, ["path", "line"], "left_semi")


def messages(found: DataFrame) -> DataFrame:
    """path, seq, role, text, date, project of the visible messages."""
    project = found.groupBy("path").agg(F.min_by("project", "line").alias("project"))
    spoken = found.filter(F.col("kind").isin("user", "assistant"))
    merged = spoken.groupBy("path", "line", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(0)).alias("block"), "text"))), lambda b: b["text"]), " ").alias("text"), F.max("ts").alias("ts"))
    dated = merged.withColumn("date", F.coalesce(F.date_format(F.try_to_timestamp("ts"), "yyyy-MM-dd"), F.lit("")))
    return dated.join(project, "path", "left").select("path", F.col("line").alias("seq"), "role", "text", "date", F.coalesce("project", F.lit("")).alias("project"))
