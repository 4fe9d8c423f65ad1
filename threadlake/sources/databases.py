"""Sessions in embedded databases as messages: path, seq, role, text, time_ms.

Rows come from the data source in ``sqlite.py`` as JSON; from there on these are
projections and joins. OpenCode keeps text in parts under messages, or in the
newer layout one row per message; a session that has a newer row is read from
there only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.operators.index import without_migrated
from threadlake.sources.sqlite import read_table


def _field(name: str, column: str = "value") -> Column:
    return F.get_json_object(column, f"$.{name}")


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return rows.withColumn("seq", seq).select("path", "seq", "role", "text", "time_ms")


def opencode(spark: SparkSession, databases: list[str]) -> DataFrame:
    messages = (
        read_table(spark, databases, "message")
        .select("db", _field("id").alias("message_id"), _field("session_id").alias("session_id"), _field("data").alias("data"))
        .select("db", "message_id", "session_id", _field("role", "data").alias("role"))
    )
    parts = (
        read_table(spark, databases, "part")
        .select("db", _field("id").alias("part_id"), _field("message_id").alias("message_id"), _field("time_created").cast("long").alias("time_ms"), _field("data").alias("data"))
        .filter(_field("type", "data") == "text")
        .select("db", "part_id", "message_id", "time_ms", _field("text", "data").alias("text"))
    )
    current = read_table(spark, databases, "session_message").select(
        "db",
        _field("id").alias("part_id"),
        _field("session_id").alias("session_id"),
        _field("type").alias("role"),
        _field("time_created").cast("long").alias("time_ms"),
        _field("data").alias("data"),
    )
    items = F.from_json(_field("content", "data"), "array<struct<type: string, text: string>>")
    said = F.array_join(F.transform(F.filter(items, lambda i: i["type"] == "text"), lambda i: i["text"]), " ")
    newer = current.select("db", "part_id", "session_id", "role", "time_ms", F.when(F.col("role") == "user", _field("text", "data")).otherwise(said).alias("text"))
    legacy = without_migrated(parts.join(messages, ["db", "message_id"]).select("db", "part_id", "session_id", "role", "time_ms", "text"), newer)
    both = newer.unionByName(legacy).filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return _ordered(both.withColumn("path", F.concat(F.lit("opencode://"), "db", F.lit("#"), "session_id")), "time_ms", "part_id")


def openclaw(spark: SparkSession, databases: list[str]) -> DataFrame:
    """Events are JSON or a compressed frame of it; either is one message row."""
    rows = read_table(spark, databases, "transcript_events").select(
        "db", _field("session_id").alias("session_id"), _field("seq").cast("long").alias("n"), F.coalesce(_field("event_json"), _field("event_zstd")).alias("event"), _field("created_at").cast("long").alias("time_ms")
    )
    content = F.get_json_object("event", "$.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    text = F.when(F.startswith(content, F.lit("[")), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")).otherwise(content)
    said = rows.select(F.concat(F.lit("openclaw://"), "db", F.lit("#"), "session_id").alias("path"), "n", "time_ms", F.get_json_object("event", "$.message.role").alias("role"), text.alias("text"))
    return _ordered(said.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != "")), "n")


def hermes(spark: SparkSession, databases: list[str]) -> DataFrame:
    """Chat rows; inactive ones go, columns an older database lacks read as null."""
    rows = read_table(spark, databases, "messages").select(
        "db",
        _field("id").cast("long").alias("n"),
        _field("session_id").alias("session_id"),
        _field("role").alias("role"),
        _field("content").alias("text"),
        (_field("timestamp").cast("double") * 1000).cast("long").alias("time_ms"),
        F.coalesce(_field("active").cast("int"), F.lit(1)).alias("active"),
    )
    said = rows.filter("active <> 0").filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return _ordered(said.withColumn("path", F.concat(F.lit("hermes://"), "db", F.lit("#"), "session_id")), "n")


def session_list(messages: DataFrame) -> DataFrame:
    """path, size, newest: what an index compares to tell which sessions changed."""
    return messages.groupBy("path").agg((F.sum(F.length("text")) + F.count("*")).cast("long").alias("size"), F.max("time_ms").alias("newest"))
