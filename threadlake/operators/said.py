"""Who wrote this text: sessions that hold pasted lines word for word.

Lines become words; a line is found where its words follow one another. The
first ``KEY_WORDS`` words of every line are its key: texts list the runs of that
length they hold and meet the keys by equality, in the scan where the counted
keys are few, and only texts that hold a key are looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.session import materialize

MAX_LINES = 8
KEY_WORDS = 3
PASTED_WORDS = 6
MAX_BROADCAST_ROWS = 100_000


def probes(texts: DataFrame, min_words: int = KEY_WORDS, trim_edges: bool = False) -> DataFrame:
    """probe, line_no, run, key: a text's longest distinct lines as words, of
    equal length the earlier first. A pasted line may begin or end within a word:
    ``trim_edges`` drops its first and last (with ``min_words=PASTED_WORDS``)."""
    lines = F.transform(F.split("text", "\n", -1), T.words)
    if trim_edges:
        lines = F.transform(lines, lambda w: F.when(F.size(w) >= 2, F.slice(w, 2, F.size(w) - 2)).otherwise(w))
    listed = texts.select("probe", F.posexplode(F.array_distinct(lines)).alias("at", "line")).filter(F.size("line") >= max(min_words, KEY_WORDS))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc(F.size("line")), "at"))
    kept = listed.withColumn("line_no", place).filter(F.col("line_no") <= MAX_LINES)
    return kept.select("probe", "line_no", F.array_join("line", " ").alias("run"), F.array_join(F.slice("line", 1, KEY_WORDS), " ").alias("key"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def wrote(texts: DataFrame, probe_lines: DataFrame) -> DataFrame:
    """probe, path, lines: texts that hold two of a probe's lines (or its only one)."""
    spaced = texts.select("path", F.concat(F.lit(" "), F.array_join(T.words(F.col("text")), " "), F.lit(" ")).alias("all"))
    # every place behind a space, with the words that follow
    runs = F.regexp_extract_all("all", F.lit("(?<= )(?=(" + " ".join(["[^ ]+"] * KEY_WORDS) + ") )"), F.lit(1))
    keys = _few(probe_lines.select("key").distinct())
    holders = materialize(spaced.select("path", F.explode(F.array_distinct(runs)).alias("key")).join(keys, "key"), "said-keys")
    candidates = _few(holders).join(probe_lines, "key").select("path", "probe", "line_no", "run")
    met = spaced.join(candidates, "path").filter(F.contains(F.col("all"), F.concat(F.lit(" "), F.col("run"), F.lit(" "))))
    needed = probe_lines.groupBy("probe").agg(F.least(F.lit(2), F.count("*")).alias("needed"))
    return met.groupBy("probe", "path").agg(F.count_distinct("line_no").alias("lines")).join(needed, "probe").filter("lines >= needed").select("probe", "path", "lines")
