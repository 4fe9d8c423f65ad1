"""The driver's tables in the shapes the operators take.

messages  path, source, role, seq, text (and date where there is one)
events    path, idx, kind, tool, input, is_error, ts, call_id
notes     path, project, type, text
chunks    id, path, vec
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("seq"), "role", "text")


def dated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as messages: text is the payload, the type is the role."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("role"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("time_ms"),
        F.col("props").alias("text"),
    )


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as tool activity, numbered per user. Purchases and errors
    are results, the rest calls; equal payloads share a call id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"),
        (F.row_number().over(order) - 1).alias("idx"),
        F.when(F.col("event_type").isin("purchase", "error"), "tool_result").otherwise("tool_call").alias("kind"),
        F.col("event_type").alias("tool"),
        F.col("props").alias("input"),
        (F.col("event_type") == "error").alias("is_error"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("time_ms"),
        F.col("props").alias("call_id"),
        F.col("value").alias("size"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("project"), F.col("lang").alias("type"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("path"), F.col("embedding").alias("vec"))


def store_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables as three stores of messages. Every third conversation has no
    dates, every other third has them on even turns only; documents have none."""
    from threadlake.sources.registry import shaped

    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("path") % 7).cast("int")), "yyyy-MM-dd")
    dated = (F.col("path") % 3 == 2) | ((F.col("path") % 3 == 1) & (F.col("seq") % 2 == 0))
    chat = messages(spark, sf_dir).withColumn("date", F.when(dated, day).otherwise("")).withColumn("project", F.concat(F.lit("/work/team-"), F.col("path") % 4))
    log = dated_messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "error", "assistant").otherwise("user")).withColumn("project", F.lit("/work/web"))
    docs = notes(spark, sf_dir).select("path", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), "text", F.lit("").alias("date"), "project")
    return shaped(chat, "chat").unionByName(shaped(log, "log")).unionByName(shaped(docs, "docs"))


def named_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with a name; one in ninety is its project's index."""
    label = F.concat("lang", F.lit("-"), "doc_id")
    name = F.when(F.col("doc_id") % 90 == 4, "MEMORY.md").otherwise(label)
    return table(spark, sf_dir, "documents").select(label.alias("path"), F.col("source").alias("project"), name.alias("name"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as messages in files: errors are in those of helpers,
    purchases in files of another system."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    own = F.concat(F.lit("/log/u-"), user)
    path = F.when(kind == "error", F.concat(own, F.lit("/subagents/"), F.col("event_id") % 9, F.lit(".jsonl"))).when(kind == "purchase", F.concat(F.lit("C:\\log\\U-"), user, F.lit(".jsonl")))
    time = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf_dir, "events").select(F.coalesce(path, F.concat(own, F.lit(".jsonl"))).alias("path"), F.date_format("ts", "yyyy-MM-dd").alias("date"), time.alias("time_ms"))


def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool activity: what a user says is a result, the rest are
    calls with their text and numbers nested in the input."""
    deep = F.struct(F.array(F.struct(F.col("role").alias("r"))).alias("a"), F.struct(F.col("turn").alias("t"), (2 * F.col("turn") + 0.5).alias("u")).alias("b"))
    made = F.to_json(F.struct(F.col("text").alias("say"), deep.alias("in"), (F.col("conv_id") % 2 == 0).alias("even")))
    call = F.col("role") != "user"
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("path"), F.col("turn").alias("idx"), F.when(call, "tool_call").otherwise("tool_result").alias("kind"), F.col("role").alias("tool"), F.when(call, made).otherwise(F.col("text")).alias("input")
    )
