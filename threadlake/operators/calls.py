"""What tool calls and their results say, as text that can be searched.

A call's text is its tool's name and the leaves of its input, each as it was
written and not as JSON escapes it, so that a command or an address is found by
its own characters. The leaves are the tokens of the JSON text that are no keys:
one pattern finds them at any depth and one parse of the list undoes the escapes,
both in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as T

# Possessive throughout: no token is tried twice and long strings need no stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf"{_STRING}(?:[\x20\t\r\n]*+:)?+|-?+[0-9][0-9.eE+-]*+|true|false"


def leaves(json: Column) -> Column:
    """The strings, numbers and flags in a JSON text, in its order, as plain text;
    nulls, empty strings and keys are none. A text that is no JSON is one leaf."""
    tokens = F.filter(F.regexp_extract_all(json, F.lit(f"(?s){_TOKEN}"), F.lit(0)), lambda t: ~F.endswith(t, F.lit(":")))
    plain = F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")
    valid = F.try_parse_json(json).isNotNull()
    return F.filter(F.when(valid, plain).otherwise(F.array(json)), lambda t: t.isNotNull() & (t != ""))


def call_text(tool: Column, json: Column) -> Column:
    """``tool: leaf leaf ...``"""
    return F.concat_ws(" ", F.concat(F.coalesce(tool, F.lit("tool")), F.lit(":")), F.coalesce(leaves(json), F.array().cast("array<string>")))


def result_text(tool: Column, output: Column) -> Column:
    return F.concat(F.coalesce(tool, F.lit("tool")), F.lit(" result: "), F.coalesce(output, F.lit("")))


def texts(events: DataFrame) -> DataFrame:
    """path, idx, kind, tool, text of the calls and results among events."""
    said = F.when(F.col("kind") == "tool_call", call_text(F.col("tool"), F.col("input"))).otherwise(result_text(F.col("tool"), F.col("input")))
    return events.filter(F.col("kind").isin("tool_call", "tool_result")).select("path", "idx", "kind", "tool", said.alias("text"))


def search(events: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """path, count, idx, snippet: sessions by how often their calls and results
    hold a term, each with its first."""
    # a term within one leaf stands in the input as it is, unless that has escapes
    raw = F.concat_ws(" ", F.coalesce("tool", F.lit("tool")), F.lit("result:"), "input")
    within = not any(c in term for c in ' :"')
    near = events.filter(T.has(raw, term) | F.contains("input", F.lit("\\"))) if within else events
    hits = texts(near).filter(T.has(F.col("text"), term))
    ranked = hits.groupBy("path").agg(F.sum(T.ascii_occurrences(F.col("text"), term)).cast("long").alias("count"), F.min(F.struct("idx", "text")).alias("first"))
    top = ranked.orderBy(F.desc("count"), F.asc("path")).limit(limit)
    return top.select("path", "count", F.col("first.idx").alias("idx"), T.snippet(F.col("first.text"), term).alias("snippet"))
