"""What a selector names: a note by path, project or a part of one, a session by an id.

All selectors are matched in one pass over the rows and reduced to their best
match by an aggregate, so a list of selectors costs as much as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as T

INDEX_NOTE = "MEMORY.md"
# Agents that keep a session's helpers a folder below it.
NESTED = ("pi", "omp")


def _plain(path: Column) -> Column:
    """Folded for ASCII, with slashes only."""
    return F.replace(T.ascii_lower(path), F.lit("\\"), F.lit("/"))


def is_subagent(path: Column, source: Column | None = None, store: Column | None = None) -> Column:
    """A helper's transcript, which is part of a session and none of its own."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.contains(plain, F.lit("/subagents/"))
    if source is None or store is None:
        return below
    inner = F.substring(plain, F.length(store) + 2, F.length(plain))
    depth = F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit("")))
    return below | (source.isin(*NESTED) & (depth != 1))


def _matches(rows: DataFrame, tiers: dict[str, Column]) -> DataFrame:
    """The rows that a selector names, once per selector, with its tier."""
    pairs = F.array(*[F.struct(F.lit(name).alias("selector"), tier.alias("tier")) for name, tier in tiers.items()])
    named = rows.withColumn("m", F.explode(F.filter(pairs, lambda p: p["tier"].isNotNull())))
    return named.select("*", F.col("m.selector").alias("selector"), F.col("m.tier").alias("tier")).drop("m")


def _with_missing(found: DataFrame, selectors: list[str]) -> DataFrame:
    asked = found.sparkSession.createDataFrame([(s,) for s in selectors], "selector string")
    return F.broadcast(asked).join(found, "selector", "left")  # as long as the argument


def select_notes(notes: DataFrame, selectors: list[str]) -> DataFrame:
    """selector, path, n for notes (path, project, name): the note with that very
    path, else the notes of that project, with that project/name or with the
    selector in their project. Of ``n`` notes the index note is meant, the first of
    several; where there is none, the selector is ambiguous and has no path."""
    selectors = list(dict.fromkeys(selectors))
    if not selectors:
        return notes.sparkSession.createDataFrame([], "selector string, path string, n long")
    path, project = F.col("path").cast("string"), F.coalesce("project", F.lit(""))
    slim = notes.select(path.alias("path"), project.alias("project"), F.col("name").cast("string").alias("name"))
    label = F.concat("project", F.lit("/"), "name")
    tier = lambda s: F.when(F.col("path") == s, 1).when((label == s) | F.contains("project", F.lit(s)), 2)
    each = _matches(slim, {s: tier(s) for s in selectors}).groupBy("selector", "tier")
    each = each.agg(F.count("*").alias("n"), F.min("path").alias("one"), F.min(F.when(F.col("name") == INDEX_NOTE, F.col("path"))).alias("index"))
    best = each.groupBy("selector").agg(F.min_by(F.struct("n", "one", "index"), "tier").alias("b"))
    # a path names one note, were it listed twice
    found = best.select("selector", F.when(F.col("b.n") == 1, F.col("b.one")).when(F.col("b.one") == F.col("selector"), F.col("b.one")).otherwise(F.col("b.index")).alias("path"), F.col("b.n").alias("n"))
    return _with_missing(found, selectors).select("selector", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def show_note(notes: DataFrame, selector: str) -> DataFrame:
    """The note that a selector names; ValueError where it names none or several."""
    (found,) = select_notes(notes, [selector]).collect()  # one row
    if found.n == 0:
        raise ValueError(f"no note matches '{selector}'")
    if found.path is None:
        raise ValueError(f"'{selector}' is ambiguous: {found.n} notes match; use a project/name")
    return notes.filter(F.col("path").cast("string") == found.path)


def _newest(rows: DataFrame, tiers: dict[str, Column], *rank: Column) -> DataFrame:
    """selector, path: by ``rank`` and then the newest of the sessions named. A row
    stands for its session, so nothing is grouped by path first."""
    date = F.when(F.col("date").isin("", "unknown"), F.lit("")).otherwise(F.coalesce("date", F.lit(""))) if "date" in rows.columns else F.lit("")
    time = F.col("time_ms").cast("long") if "time_ms" in rows.columns else F.lit(None).cast("long")
    named = _matches(rows.withColumn("path", F.col("path").cast("string")), tiers)
    # a session's date and time are its newest of each, not of one row
    sessions = named.groupBy("selector", "path", *[r.alias(f"r{k}") for k, r in enumerate((F.col("tier"), *rank))]).agg(F.max(date).alias("date"), F.max(time).alias("time_ms"))
    best = F.struct(*[F.col(f"r{k}") for k in range(1 + len(rank))], "date", "time_ms", "path")
    return sessions.groupBy("selector").agg(F.max_by("path", best).alias("path"))


def sessions_by_id(rows: DataFrame, ids: list[str]) -> DataFrame:
    """selector, path: of the sessions whose path holds an id the one whose own
    file it is, then one that is no helper's, then the newest."""
    ids = [i for i in dict.fromkeys(ids) if i]
    plain = _plain(F.col("path").cast("string"))
    own = lambda i: F.contains(plain, F.lit(f"/{i.lower()}.jsonl")).cast("int")
    tiers = {i: F.when(F.contains(F.lower(F.col("path").cast("string")), F.lit(i.lower())), own(i)) for i in ids}
    if not ids:
        return rows.sparkSession.createDataFrame([], "selector string, path string")
    have = [F.col(c) if c in rows.columns else None for c in ("source", "store")]
    main = (~is_subagent(F.col("path"), *have)).cast("int")
    return _with_missing(_newest(rows, tiers, main), ids)


def session_parts(rows: DataFrame, session: str, parts: list[str]) -> DataFrame:
    """selector, path: the newest transcript that lies right under a session's
    folder as ``<part>.jsonl``."""
    parts = [p for p in dict.fromkeys(parts) if p]
    if not session or not parts:
        return rows.sparkSession.createDataFrame([], "selector string, path string")
    plain = _plain(F.col("path").cast("string"))
    tiers = {p: F.when(F.endswith(plain, T.ascii_lower(F.lit(f"{session}/{p}.jsonl"))), 1) for p in parts}
    return _with_missing(_newest(rows, tiers), parts)
