"""Tool-activity measures: pairing, repeats, latency, per-tool sums.

Calls and results are paired as of their place in the session: a result belongs
to the latest earlier call with its id. That is a running last value over one
ordering of the session, not a join, so a call id with many results costs no
more than its rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T

OVERSIZED = 10_000


def fingerprint(tool, payload):
    """Equal tool and equal JSON (keys in any order) give an equal value."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(payload)), payload)
    return F.sha2(F.concat(tool, F.lit("\x00"), F.coalesce(canonical, F.lit(""))), 256)


#: Comments, strings and regex literals of a script, in the order they are tried.
LITERALS = (
    r"/\*(?s:.*?)\*/",
    r"//[^\n]*+",
    r'"(?:[^"\\]++|\\(?s:.))*+"',
    r"'(?:[^'\\]++|\\(?s:.))*+'",
    r"`(?:[^`\\]++|\\(?s:.))*+`",
    r"/(?:[^/\n\\]++|\\.)++/[dgimsuvy]*+",
)


def nested_calls(payload):
    """Names called as ``tools.name(`` in a script, outside comments and literals."""
    bare = F.regexp_replace(payload, "|".join(LITERALS), " ")
    return F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_.$])tools\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))


def nested_sites(events: DataFrame) -> DataFrame:
    """path, idx, names of the calls inside wrapper calls."""
    wrapped = events.filter((F.col("kind") == "tool_call") & T.is_wrapper(F.col("tool")))
    return wrapped.select("path", "idx", nested_calls(F.col("input")).alias("names")).filter(F.size("names") > 0)


def without_observations(events: DataFrame) -> DataFrame:
    """Calls that act, not those that only wait for or read from another."""
    return events.filter((F.col("kind") != "tool_call") | ~T.is_observation(F.col("tool")))


def explanation_prompt(sessions: list[dict], found: list[dict]) -> str:
    """The text a pluggable answerer explains a profile from."""
    lines = ["Explain these tool-activity measures. Cite calls as [path#idx]; cite none that is not listed.", "Sessions:"]
    lines += [f"- {s['path']}: {s['tool_calls']} calls, {s['repeated_calls']} repeated, {s['error_results']} errors" for s in sessions]
    lines += ["Calls:", *(f"- [{c['path']}#{c['call_idx']}] {c['tool']}, output {c['output']}" for c in found)]
    return "\n".join(lines)


def cited(answer: str, found: list[dict]) -> list[str]:
    """The calls an answer cites; ValueError if it cites one it was not given."""
    known = {f"{c['path']}#{c['call_idx']}" for c in found}
    named = list(dict.fromkeys(re.findall(r"\[([^\]\s]+#[0-9]+)\]", answer)))
    if wrong := [n for n in named if n not in known]:
        raise ValueError(f"cites calls it was not given: {', '.join(wrong)}")
    return named


def paired(events: DataFrame) -> DataFrame:
    """Results with the call they belong to: call_idx, call_tool, call_ms, nth."""
    upto = Window.partitionBy("path", "call_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    call = F.when(F.col("kind") == "tool_call", F.struct("idx", "tool", "time_ms"))
    keyed = events.filter((F.col("call_id").isNotNull()) & (F.col("call_id") != "")).withColumn("call", F.last(call, ignorenulls=True).over(upto))
    results = keyed.filter("kind = 'tool_result' and call is not null")
    nth = F.row_number().over(Window.partitionBy("path", "call.idx").orderBy("idx"))
    return results.select("path", "idx", "size", "is_error", "time_ms", F.col("call.idx").alias("call_idx"), F.col("call.tool").alias("call_tool"), F.col("call.time_ms").alias("call_ms"), nth.alias("nth"))


def latencies(events: DataFrame) -> DataFrame:
    """path, call_idx, latency_ms of each call's first result, if not negative."""
    first = paired(events).filter("nth = 1 and time_ms >= call_ms")
    return first.select("path", "call_idx", (F.col("time_ms") - F.col("call_ms")).alias("latency_ms"))


def repeats(events: DataFrame) -> DataFrame:
    """path, idx, repeat_of: calls equal to an earlier one of the session."""
    calls = events.filter("kind = 'tool_call'").withColumn("fp", fingerprint(F.col("tool"), F.col("input")))
    first = F.first("idx").over(Window.partitionBy("path", "fp").orderBy("idx"))
    return calls.withColumn("repeat_of", first).filter("repeat_of < idx").select("path", "idx", "tool", "repeat_of")


def repeat_groups(events: DataFrame) -> DataFrame:
    """path, tool, first_idx, calls of each group of equal calls, two or more."""
    calls = events.filter("kind = 'tool_call'").withColumn("fp", fingerprint(F.col("tool"), F.col("input")))
    return calls.groupBy("path", "tool", "fp").agg(F.min("idx").alias("first_idx"), F.count("*").alias("calls")).filter("calls > 1").drop("fp")


def per_tool(events: DataFrame) -> DataFrame:
    """path, tool, calls, output, errors; results count for their call's tool."""
    calls = events.filter("kind = 'tool_call'").groupBy("path", "tool").agg(F.count("*").alias("calls"))
    results = paired(events).groupBy("path", F.col("call_tool").alias("tool")).agg(F.sum("size").alias("output"), F.count_if("is_error").alias("errors"))
    return calls.join(results, ["path", "tool"], "left").select("path", "tool", "calls", F.coalesce(F.round("output", 4), F.lit(0.0)).alias("output"), F.coalesce("errors", F.lit(0)).alias("errors"))


def metrics(events: DataFrame, threshold: float = OVERSIZED) -> DataFrame:
    """One row of counters per session."""
    pairs = paired(events)
    matched = pairs.groupBy("path").agg(F.count("*").alias("matched_results"), F.count_distinct("call_idx").alias("answered_calls"))
    repeated = repeats(events).groupBy("path").agg(F.count("*").alias("repeated_calls"))
    result = F.col("kind") == "tool_result"
    base = events.groupBy("path").agg(
        F.count_if(F.col("kind") == "tool_call").alias("tool_calls"),
        F.count_if(result).alias("tool_results"),
        F.count_if(result & (F.col("size") > threshold)).alias("oversized_results"),
        F.count_if(result & F.col("is_error")).alias("error_results"),
    )
    joined = base.join(matched, "path", "left").join(repeated, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "path",
        "tool_calls",
        "tool_results",
        "oversized_results",
        "error_results",
        zero("repeated_calls").alias("repeated_calls"),
        (F.col("tool_results") - zero("matched_results")).alias("unmatched_results"),
        (F.col("tool_calls") - zero("answered_calls")).alias("calls_without_results"),
    )


def evidence(events: DataFrame, per_session: int = 12, overall: int = 40) -> DataFrame:
    """path, call_idx, tool, output, rank: calls with an error or a repeat, by
    output, a few per session and overall."""
    output = paired(events).groupBy("path", F.col("call_idx").alias("idx")).agg(F.sum("size").alias("output"), F.bool_or("is_error").alias("failed"))
    calls = events.filter("kind = 'tool_call'").select("path", "idx", "tool").join(output, ["path", "idx"], "left").join(repeats(events).select("path", "idx", "repeat_of"), ["path", "idx"], "left")
    flagged = calls.filter("failed or repeat_of is not null").withColumn("output", F.coalesce(F.round("output", 4), F.lit(0.0)))
    order = [F.desc("output"), F.asc("idx")]
    ranked = flagged.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter(F.col("rank") <= per_session)
    return ranked.orderBy(F.desc("output"), F.asc("path"), F.asc("idx")).limit(overall).select("path", F.col("idx").alias("call_idx"), "tool", "output", "rank")


def fifo_pairs(steps: DataFrame) -> DataFrame:
    """For logs without call ids (path, line, kind in call/result/reply): the k-th
    result after a reply answers the k-th call after it."""
    order = Window.partitionBy("path").orderBy("line")
    grouped = steps.withColumn("block", F.sum((F.col("kind") == "reply").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy("path", "block", "kind").orderBy("line"))
    ranked = grouped.withColumn("nth", nth)
    calls = ranked.filter("kind = 'call'").select("path", "block", "nth", F.col("line").alias("call_line"))
    results = ranked.filter("kind = 'result'").select("path", "block", "nth", F.col("line").alias("result_line"))
    return results.join(calls, ["path", "block", "nth"], "left").select("path", "result_line", "call_line")
