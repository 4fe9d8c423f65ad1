"""Markdown notes: project memories and wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIKI_SKIPPED = ("index.md", "log.md", "schema.md")


def memories(spark: SparkSession, root: str) -> DataFrame:
    """project, name, path, source, text of <root>/<project>/memory/*.md."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    named = files.filter(F.col("path").rlike(r"/memory/[^/.][^/]*\.md$"))
    return _notes(named, F.regexp_extract("path", r"/([^/]+)/memory/[^/]+$", 1), "memory")


def wiki(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    named = files.filter(F.col("path").rlike(r"/pages/[^/.][^/]*\.md$") & ~F.regexp_extract("path", "([^/]+)$", 1).isin(*WIKI_SKIPPED))
    return _notes(named, F.lit("wiki"), "wiki")


def _notes(files: DataFrame, project, source: str) -> DataFrame:
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select(project.alias("project"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", F.lit(source).alias("source"), text.alias("text"))
