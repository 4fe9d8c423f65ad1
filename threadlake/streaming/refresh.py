"""Incremental refresh of a messages table from a folder of logs that grow.

``files`` (see ``versions``) lists every log with its size, time, the byte up to
which its lines are in, the hash of its first bytes and the batches that hold
its rows; ``messages/batch=...`` holds rows. A refresh lists the folder, compares
it with the newest version, and looks at the first and last bytes of new and
changed logs: where the head is the one known, only the complete lines behind
what is in are read, as a further batch of that log; a log with another head, or
a shorter one, is read anew and its old batches no longer count. A last line that
is still being written comes in with the change that completes it. Logs that
vanished leave the list; one that cannot be read keeps what it has, is counted as
skipped and looked at again next time.

Names and lines of logs stay in tables and tasks; the driver sees counts. The new
version counts when its marker is published: a refresh that fails midway leaves
the table as it was, and the next one is not held up by what it left.
``compact`` gathers the rows that count in one batch and deletes the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import index
from threadlake.session import materialize
from threadlake.sources import log_ranges, transcripts
from threadlake.streaming.versions import Versions, delete, names

FILES = "path string, size long, mtime_ms long, consumed long, head string, head_bytes long, project string, batches array<string>"
MESSAGES = "path string, seq long, role string, text string, date string, project string, batch string"


def listing(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """path, size, mtime_ms of the logs below a folder, and the name to open each by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("path").alias("file"))


def _files(spark: SparkSession, table: str) -> Versions:
    return Versions(spark, f"{table}/files", FILES)


def known_files(spark: SparkSession, table: str) -> DataFrame:
    """The logs of the newest version."""
    return _files(spark, table).read()


def messages(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows: of each listed log those of its own batches."""
    if not names(spark, f"{table}/messages"):
        return spark.createDataFrame([], MESSAGES).drop("batch")
    rows = spark.read.schema(MESSAGES).parquet(f"{table}/messages")
    owned = known_files(spark, table).select("path", F.explode("batches").alias("batch"))
    return rows.join(owned, ["path", "batch"], "left_semi").drop("batch")


def refresh(spark: SparkSession, root: str, source: str, table: str, rebuild: bool = False) -> dict[str, int]:
    """Bring the table up to date. How many logs were new, grown, rewritten,
    gone, skipped and same, and ``lines``, how many were read. ``rebuild`` takes
    every log as new."""
    files = _files(spark, table)
    version = files.newest()
    known = files.read(version)
    found = materialize(listing(spark, root), "refresh-listing")
    actions = materialize(index.delta(known.limit(0) if rebuild else known, found), "refresh-delta")
    counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}  # four kinds
    if not counts.keys() - {"same"} and not rebuild:
        return counts
    changed = found.join(actions.filter("action in ('new', 'changed')").select("path"), "path")
    old = known.select("path", F.col("size").alias("known_size"), "consumed", F.col("head").alias("known_head"), F.col("head_bytes").alias("known_head_bytes"))
    old = old.limit(0) if rebuild else old
    survey = materialize(log_ranges.surveyed(changed.join(old, "path", "left")), "refresh-survey")
    seen = {r.action: r["count"] for r in survey.groupBy("action").count().collect()}
    batch = uuid.uuid4().hex
    lines = materialize(log_ranges.read_lines(survey, source), "refresh-lines")
    n_lines = lines.count()
    if n_lines:
        parsed = transcripts.messages(transcripts.events(lines))
        earlier = known.select("path", F.col("project").alias("was"))
        parsed = parsed.join(earlier, "path", "left").withColumn("project", F.coalesce(F.nullif("project", F.lit("")), "was", F.lit(""))).drop("was")
        parsed.write.parquet(f"{table}/messages/batch={batch}")
    same = known.join(actions.filter("action = 'same'").select("path"), "path", "left_semi")
    kept = known.join(survey.filter("action = 'skipped'").select("path"), "path", "left_semi")  # as it was, to be tried again
    projects = spark.read.schema(MESSAGES).parquet(f"{table}/messages/batch={batch}").groupBy("path").agg(F.max("project").alias("said")) if n_lines else spark.createDataFrame([], "path string, said string")
    before = known.select("path", F.col("project").alias("was"), F.col("batches").alias("had"))
    fresh = (
        survey.filter("action <> 'skipped'")
        .join(projects, "path", "left")
        .join(before, "path", "left")
        .withColumn("had", F.when(F.col("action") == "grown", F.col("had")).otherwise(F.array().cast("array<string>")))
        .select(
            "path", "size", "mtime_ms", F.col("stop").alias("consumed"), "head", "head_bytes",
            F.coalesce(F.nullif("said", F.lit("")), F.when(F.col("action") == "grown", F.col("was")), F.lit("")).alias("project"),
            F.when(F.col("said").isNotNull(), F.array_append("had", F.lit(batch))).otherwise(F.col("had")).alias("batches"),
        )
    )
    files.publish(same.unionByName(kept).unionByName(fresh), version)
    out = {k: counts[k] for k in ("same", "gone") if k in counts} | seen
    return out | {"lines": n_lines}


def compact(spark: SparkSession, table: str) -> int:
    """Gather the rows that count in one batch and delete all others; how many
    batches went. A reader of the version before may fail; it reads again."""
    files = _files(spark, table)
    version = files.newest()
    if not version:
        return 0
    batch = uuid.uuid4().hex
    messages(spark, table).repartition("path").sortWithinPartitions("path", "seq").write.parquet(f"{table}/messages/batch={batch}")
    one = F.when(F.size("batches") > 0, F.array(F.lit(batch))).otherwise(F.col("batches"))
    files.publish(files.read(version).withColumn("batches", one), version)
    files.vacuum()
    stale = [n for n in names(spark, f"{table}/messages") if n.startswith("batch=") and n != f"batch={batch}"]
    for name in stale:
        delete(spark, f"{table}/messages/{name}")
    return len(stale)


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per day and type over a stream of events, closed by watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"))
