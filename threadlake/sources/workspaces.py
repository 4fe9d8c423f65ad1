"""The folder that a conversation was about, where its log does not say it.

A table of summaries beside the logs names the folders of a conversation as
addresses; conversations that it does not have are looked up in the prompt
history, where the first entry counts.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.paths import compact_home, percent_decode
from threadlake.sources.sqlite import read_table

FOLDER = r"^(.*)[/\\]brain[/\\]([^/\\]+)[/\\]"


def first_folder(addresses: Column) -> Column:
    """The first of a JSON list of file addresses as a local path; null where it
    is another kind of address."""
    first = F.from_json(addresses, "array<string>")[0]
    path = percent_decode(F.regexp_extract(first, "(?s)^file://(.*)$", 1))
    drive = path.rlike("^/[A-Za-z]:")
    return F.when(F.startswith(first, F.lit("file://")), F.when(drive, F.substring(path, F.lit(2), F.length(path))).otherwise(path))


def workspaces(spark: SparkSession, bases: list[str]) -> DataFrame:
    """base, conversation_id, workspace of the folders that hold a ``brain``."""
    none = spark.createDataFrame([], "base string, conversation_id string, workspace string, tier int, n long")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    parts = [none]
    there = [d for b in bases if os.path.exists(d := os.path.join(b, "conversation_summaries.db"))]
    if there:
        rows = read_table(spark, there, "conversation_summaries")
        folder = F.regexp_extract("db", r"^(.*)[/\\][^/\\]+$", 1)
        parts.append(rows.select(folder.alias("base"), field("conversation_id").alias("conversation_id"), first_folder(field("workspace_uris")).alias("workspace"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("n")))
    for base in bases:
        if os.path.exists(history := os.path.join(base, "history.jsonl")):
            whole = spark.read.text(history, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1)).alias("n", "value"))
            parts.append(whole.select(F.lit(base).alias("base"), field("conversationId").alias("conversation_id"), field("workspace").alias("workspace"), F.lit(1).alias("tier"), F.col("n").cast("long").alias("n")))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    known = found.filter((F.coalesce("conversation_id", F.lit("")) != "") & (F.coalesce("workspace", F.lit("")) != ""))
    return known.groupBy("base", "conversation_id").agg(F.min_by("workspace", F.struct("tier", "n")).alias("workspace"))


def with_workspace(messages: DataFrame, known: DataFrame, home: str | None = None) -> DataFrame:
    """Messages whose project is their conversation's folder where it is known."""
    plain = F.regexp_replace("path", "^file:/*/", "/")
    keyed = messages.withColumn("base", F.regexp_extract(plain, FOLDER, 1)).withColumn("conversation_id", F.regexp_extract(plain, FOLDER, 2))
    folder = compact_home(F.col("workspace"), home) if home else F.col("workspace")
    joined = keyed.join(known, ["base", "conversation_id"], "left").withColumn("project", F.coalesce(folder, F.col("project")))
    return joined.select(*messages.columns)
