"""Ranked literal search, per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T

VISIBLE = ("user", "assistant")
MIN_TERM = 3


def visible(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin(*VISIBLE))


def hits(messages: DataFrame, term: str, since: str | None = None) -> DataFrame:
    """Rows that hold the term, with their occurrences."""
    found = messages.filter(T.has(F.col("text"), term))
    if since:
        found = found.filter(T.dated_since(F.col("date"), since))
    return found.withColumn("hits", T.ascii_occurrences(F.col("text"), term))


def rank(messages: DataFrame, term: str, limit: int = 10, since: str | None = None) -> DataFrame:
    """path, count[, date]: sessions by occurrences, then date, then path."""
    dated = "date" in messages.columns
    aggregates = [F.sum("hits").cast("long").alias("count")] + ([F.min("date").alias("date")] if dated else [])
    order = [F.desc("count")] + ([F.desc("date")] if dated else []) + [F.asc("path")]
    return hits(messages, term, since).groupBy("path").agg(*aggregates).orderBy(*order).limit(limit)


def snippets(messages: DataFrame, ranked: DataFrame, term: str, per_path: int = 3) -> DataFrame:
    """path, n, seq, role, snippet: the first hits of the ranked sessions only.

    The ranked side has at most ``limit`` rows, so texts are read again for
    those sessions alone (a broadcast semi join).
    """
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq"))
    kept = messages.filter(T.has(F.col("text"), term)).join(F.broadcast(ranked.select("path")), "path", "left_semi")
    return kept.withColumn("n", place).filter(F.col("n") <= per_path).select("path", "n", "seq", "role", T.snippet(F.col("text"), term).alias("snippet"))


def matching_lines(texts: DataFrame, term: str) -> DataFrame:
    """path, count of lines that hold the term, as a direct scan counts."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: T.has(line, term))
    return texts.filter(T.has(F.col("text"), term)).groupBy("path").agg(F.sum(F.size(lines)).cast("long").alias("count")).filter("count > 0")


def recent_sessions(messages: DataFrame, since: str = "", limit: int = 10) -> DataFrame:
    """path, date, time_ms, total: newest first; undated sessions count as ''."""
    date = F.max(F.when(F.col("date").isin("", "unknown"), "").otherwise(F.col("date")))
    grouped = messages.groupBy("path").agg(date.alias("date"), F.max("time_ms").alias("time_ms")).filter(F.col("date") >= since)
    newest = grouped.orderBy(F.desc("date"), F.desc("time_ms"), F.asc("path")).limit(limit)
    return newest.join(F.broadcast(grouped.agg(F.count("*").alias("total"))))  # one row


def rows_with_words(messages: DataFrame, words: list[str], limit: int, role: str = "assistant") -> DataFrame:
    """Newest rows of a role that hold all words of three letters or more."""
    needed = [w for w in words if len(w) >= MIN_TERM]
    kept = messages.filter(F.col("role") == role).filter(T.all_of(T.has(F.col("text"), w) for w in needed))
    return kept.orderBy(F.desc("seq"), F.asc("path")).limit(limit)


def trigram_index(messages: DataFrame) -> DataFrame:
    """(trigram, path, seq): the inverted form of a text column, to be stored."""
    # Characters are taken apart once: a substring walks a text from its start.
    rows = messages.filter(F.length(F.lower("text")) >= MIN_TERM).select("path", "seq", F.split(F.lower("text"), "").alias("c"))
    grams = F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda k: F.concat(F.get("c", k), F.get("c", k + 1), F.get("c", k + 2)))
    return rows.select("path", "seq", F.explode(F.array_distinct(grams)).alias("trigram"))


def rank_indexed(messages: DataFrame, index: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """``rank`` through the index: rows that hold every trigram of the term, then
    the literal itself. Terms under three characters have no trigram and scan."""
    low = term.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if not grams:
        return rank(messages, term, limit)
    met = index.filter(F.col("trigram").isin(*grams)).groupBy("path", "seq").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return rank(messages.join(met, ["path", "seq"], "left_semi"), term, limit)
