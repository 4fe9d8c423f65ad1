"""The materialized index: deltas, upserts, totals, addresses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def delta(known: DataFrame, listing: DataFrame) -> DataFrame:
    """path, action: new, changed, gone or same, by size and modification time."""
    k = known.select("path", F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime"))
    action = (
        F.when(F.col("old_size").isNull(), "new")
        .when(F.col("size").isNull(), "gone")
        .when((F.col("size") != F.col("old_size")) | (F.col("mtime_ms") != F.col("old_mtime")), "changed")
        .otherwise("same")
    )
    return k.join(listing.select("path", "size", "mtime_ms"), "path", "full_outer").select("path", action.alias("action"))


def upsert(rows: DataFrame, updates: DataFrame, *keys: str) -> DataFrame:
    """Replace by key: old rows of updated keys go, the updates come in."""
    return rows.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates)


def after_cursor(rows: DataFrame, time_updated: int, last_id: str) -> DataFrame:
    """Rows changed since a cursor of (time_updated, id)."""
    return rows.filter((F.col("time_updated") > time_updated) | ((F.col("time_updated") == time_updated) & (F.col("id") > last_id)))


def without_migrated(legacy: DataFrame, current: DataFrame, key: str = "session_id") -> DataFrame:
    """Legacy rows of sessions that have no row in the newer layout."""
    return legacy.join(current.select(key).distinct(), key, "left_anti")


def totals(files: DataFrame, messages: DataFrame) -> DataFrame:
    """files, messages, bytes, schema_version in one row."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    b = messages.agg(F.count("*").alias("messages"))
    return a.join(F.broadcast(b)).withColumn("schema_version", F.lit(SCHEMA_VERSION))  # a row each


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """path, n: sessions whose id starts with the prefix, and how many there are."""
    found = sessions.select("path").distinct().filter(F.startswith(F.col("path").cast("string"), F.lit(prefix)))
    return found.join(F.broadcast(found.agg(F.count("*").alias("n"))))  # one row


def address(scheme: str, source, path):
    """scheme://source/id of a session: the path's UUID, or its file stem."""
    uuid = F.regexp_extract(path, "([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    stem = F.regexp_extract(path, r"([^/\\]+?)(\.[A-Za-z0-9]+)?$", 1)
    return F.concat(F.lit(f"{scheme}://"), source, F.lit("/"), F.when(uuid != "", uuid).otherwise(stem))


def parse_address(column):
    """source, id, part and event of an address."""
    pattern = r"^[a-z]+://([^/]+)/([^/#]+)(?:/([^#]+))?(?:#event-([0-9]+))?$"
    part = lambda k: F.nullif(F.regexp_extract(column, pattern, k), F.lit(""))
    return F.struct(part(1).alias("source"), part(2).alias("id"), part(3).alias("part"), part(4).cast("long").alias("event"))


UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
MIN_PREFIX = 8


def session_id(path):
    """The UUID in a path, else what follows # in a locator, else the file's stem."""
    uuid = F.regexp_extract(path, f"({UUID})", 1)
    virtual = F.regexp_extract(path, "#([^#]+)$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.jsonl$", "")
    return F.when(uuid != "", uuid).when(virtual != "", virtual).otherwise(stem)


def exclude(sessions: DataFrame, names: list[str]) -> DataFrame:
    """Sessions whose path, stem or id is not among the names, by two joins on equality."""
    if not names:
        return sessions
    path = F.col("path").cast("string")
    unwanted = F.broadcast(sessions.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string"))  # as long as the argument
    return sessions.join(unwanted, path == F.col("name"), "left_anti").join(unwanted, session_id(path) == F.col("name"), "left_anti")


def resolve(sessions: DataFrame, argument: str) -> str:
    """The path that an address, an id or a unique prefix of one names; anything
    else is a path already. ValueError lists the ids of an ambiguous prefix."""
    if m := re.match(r"^[a-z]+://[^/#]+/([^/#]+)", argument):
        argument = m[1]
    elif not re.fullmatch(f"[0-9a-f-]{{{MIN_PREFIX},36}}", argument):
        return argument
    found = sessions.select("path").distinct().withColumn("id", session_id(F.col("path"))).filter(F.startswith(F.col("id"), F.lit(argument)))
    rows = found.orderBy("id", "path").limit(20).collect()
    ids = list(dict.fromkeys(r.id for r in rows))
    if len(ids) > 1 and argument not in ids:
        raise ValueError(f"ambiguous: {', '.join(ids)}")
    if not rows:
        raise ValueError(f"no session with id {argument}")
    return next((r.path for r in rows if r.id == argument), rows[0].path)
