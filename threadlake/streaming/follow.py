"""Following the sessions of a chat database as it changes.

Two streams, one of text parts in the older layout and one of messages in the
newer, append what changed to a folder each; a micro-batch is a folder under its
own number, so one that runs again replaces itself. Reading takes of every row
its newest state; a session that has a row in the newer layout is read from
there only, so its older rows go as soon as the first newer one is in.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.operators.index import without_migrated
from threadlake.sources.sqlite import read_table
from threadlake.sources.sqlite_changes import changes
from threadlake.streaming.versions import names

ROWS = "db string, part_id string, session_id string, role string, time_ms long, text string, time_updated long, batch long"


def _field(name: str, column: str = "value"):
    return F.get_json_object(column, f"$.{name}")


def _parts(rows: DataFrame, databases: list[str]) -> DataFrame:
    """Text parts with the role of their message; a part that is no text (any
    more) has none."""
    spark = rows.sparkSession
    there = [d for d in databases if os.path.exists(d)]
    roles = read_table(spark, there, "message").select("db", _field("id").alias("message_id"), _field("session_id").alias("session_id"), F.get_json_object(_field("data"), "$.role").alias("role"))
    text = F.when(_field("type", "data") == "text", _field("text", "data"))
    parts = rows.select("db", F.col("id").alias("part_id"), _field("message_id").alias("message_id"), _field("time_created").cast("long").alias("time_ms"), "time_updated", _field("data").alias("data"))
    return parts.withColumn("text", text).join(roles, ["db", "message_id"]).select("db", "part_id", "session_id", "role", "time_ms", "text", "time_updated")


def _current(rows: DataFrame) -> DataFrame:
    items = F.from_json(_field("content", "data"), "array<struct<type: string, text: string>>")
    said = F.array_join(F.transform(F.filter(items, lambda i: i["type"] == "text"), lambda i: i["text"]), " ")
    found = rows.select("db", F.col("id").alias("part_id"), _field("session_id").alias("session_id"), _field("type").alias("role"), _field("time_created").cast("long").alias("time_ms"), "time_updated", _field("data").alias("data"))
    return found.withColumn("text", F.when(F.col("role") == "user", _field("text", "data")).otherwise(said)).select("db", "part_id", "session_id", "role", "time_ms", "text", "time_updated")


def follow(spark: SparkSession, databases: list[str], table: str, checkpoint: str) -> dict[str, int]:
    """Take in what has changed since the last run; rows read of either layout."""
    read = {}
    for layout, source, shape in (("legacy", "part", lambda rows: _parts(rows, databases)), ("current", "session_message", _current)):

        def write(rows: DataFrame, number: int, layout=layout, shape=shape) -> None:
            shape(rows).write.mode("overwrite").parquet(f"{table}/{layout}/batch={number}")

        query = changes(spark, databases, source).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{layout}").trigger(availableNow=True).start()
        query.awaitTermination()
        read[layout] = sum(p["numInputRows"] for p in query.recentProgress)
    return read


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    if not names(spark, folder):
        return spark.createDataFrame([], ROWS)
    rows = spark.read.schema(ROWS).parquet(folder)
    latest = F.row_number().over(Window.partitionBy("db", "part_id").orderBy(F.desc("time_updated"), F.desc("batch")))
    return rows.withColumn("latest", latest).filter("latest = 1").drop("latest")


def messages(spark: SparkSession, table: str) -> DataFrame:
    """path, seq, role, text, time_ms of the sessions as they now stand."""
    current = _newest(spark, f"{table}/current")
    legacy = without_migrated(_newest(spark, f"{table}/legacy"), current)
    both = current.unionByName(legacy).filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    both = both.withColumn("path", F.concat(F.lit("opencode://"), "db", F.lit("#"), "session_id"))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("time_ms", "part_id"))).select("path", "seq", "role", "text", "time_ms")
