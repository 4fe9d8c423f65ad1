"""Search, find and last over messages of all stores, in one call each.

Messages are rows of ``registry.MESSAGES``: source, path, seq, role, text, date,
time_ms, project. A session is a path. The legs (agent, date, project, sessions
left out) are filters or semi joins in one plan; what is ranked is one row a
session, and texts are read again for the few sessions that are returned.

Dates of sessions, where a date is asked for: a session counts as of the newest
date of its rows that matched; where none of these has a date, of the newest of
all its visible rows; where none has, its ``created`` date if it has one. A session
without any date stays in, as nothing says that it is old.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators import find, index, search
from threadlake.sources.registry import in_project


@dataclass(frozen=True)
class Legs:
    """What is asked besides the words."""

    source: str = "all"
    since: str | None = None
    project: str | None = None
    exclude: tuple[str, ...] = field(default_factory=tuple)


def _known(date: Column) -> Column:
    """The date, null where there is none."""
    return F.when(~date.isin("", "unknown"), date)


def within(messages: DataFrame, legs: Legs) -> DataFrame:
    """The rows of sessions that the legs leave, dates apart."""
    rows = messages if legs.source == "all" else messages.filter(F.col("source") == legs.source)
    if legs.project:
        rows = in_project(rows, legs.project)
    return index.exclude(rows, list(legs.exclude)) if legs.exclude else rows


def search_sessions(messages: DataFrame, term: str, legs: Legs = Legs(), limit: int = 10, per_path: int = 3) -> DataFrame:
    """source, path, project, date, count, n, role, snippet: the sessions with
    most occurrences, then the newest, each with its first hits. With a date only
    messages from then on match; undated ones do."""
    term = term.strip()
    if not term:
        raise ValueError("search token must not be empty")
    rows = search.visible(within(messages, legs))
    matched = search.hits(rows, term, legs.since)
    grouped = matched.groupBy("source", "path").agg(F.sum("hits").cast("long").alias("count"), F.coalesce(F.max(_known(F.col("date"))), F.lit("unknown")).alias("date"), F.max("project").alias("project"))
    best = grouped.orderBy(F.desc("count"), F.desc("date"), "source", "path").limit(limit)
    place = F.row_number().over(Window.partitionBy("source", "path").orderBy("seq"))
    shown = matched.join(F.broadcast(best.select("source", "path")), ["source", "path"], "left_semi")  # ``limit`` rows
    shown = shown.withColumn("n", place).filter(F.col("n") <= per_path).select("source", "path", "n", "role", T.snippet(F.col("text"), term).alias("snippet"))
    return F.broadcast(best).join(shown, ["source", "path"]).select("source", "path", "project", "date", "count", "n", "role", "snippet")


def session_dates(messages: DataFrame, matched: DataFrame) -> DataFrame:
    """source, path, as_of: the date of every session with a matched row."""
    keys = ["source", "path"]
    own = matched.groupBy(*keys).agg(F.max(_known(F.col("date"))).alias("matched"))
    created = [F.max(_known(F.col("created"))).alias("created")] if "created" in messages.columns else [F.lit(None).cast("string").alias("created")]
    rest = search.visible(messages).groupBy(*keys).agg(F.max(_known(F.col("date"))).alias("any"), *created)
    return own.join(rest, keys, "left").select(*keys, F.coalesce("matched", "any", "created", F.lit("unknown")).alias("as_of"))


def _matching(rows: DataFrame, terms: list[str]) -> DataFrame:
    prompt = (F.col("role") != "user") | T.is_prompt(F.col("text"))
    return search.visible(rows).filter(T.any_of(T.has(F.col("text"), t) for t in terms)).filter(prompt)


def active_since(messages: DataFrame, since: str) -> DataFrame:
    """The rows of sessions that exist with a message from the date on (a semi join)."""
    alive = messages.filter(_known(F.col("date")) >= since).select("source", "path").distinct()
    return messages.join(alive, ["source", "path"], "left_semi")


def find_sessions(messages: DataFrame, terms: list[str], legs: Legs = Legs(), limit: int = 5, user_only: bool = False) -> DataFrame:
    """source, path, project, date, score, matched, opening: sessions that match
    all terms that the best one matches."""
    terms = find.distinct_terms(terms)
    if not terms:
        raise ValueError("at least one term is needed")
    rows = within(messages, legs)
    # the finder's key is a path: sessions of two stores may share one
    keyed = rows.withColumn("session", F.struct("source", "path")).drop("date")
    if legs.since:
        dates = session_dates(rows, _matching(rows, terms))
        recent = dates.filter((F.col("as_of") == "unknown") | (F.col("as_of") >= legs.since))
        keyed = keyed.join(recent, ["source", "path"])
    else:
        keyed = keyed.withColumn("as_of", F.lit(None).cast("string"))
    ranked = find.relaxed(keyed.drop("path").withColumnRenamed("session", "path"), terms, limit, user_only)
    few = ranked.select(F.col("path.source").alias("source"), F.col("path.path").alias("path"), "score", "matched")
    mine = rows.join(F.broadcast(few.select("source", "path")), ["source", "path"], "left_semi")  # ``limit`` rows
    about = mine.groupBy("source", "path").agg(F.max("project").alias("project"))
    dated = session_dates(mine, _matching(mine, terms)).withColumnRenamed("as_of", "date")
    prompts = mine.filter((F.col("role") == "user") & T.is_prompt(F.col("text"))).groupBy("source", "path").agg(F.min_by("text", "seq").alias("first"))
    out = F.broadcast(few).join(about, ["source", "path"]).join(dated, ["source", "path"]).join(prompts, ["source", "path"], "left")
    return out.select("source", "path", "project", "date", "score", "matched", T.preview(T.trim(F.col("first"))).alias("opening"))


def last_sessions(messages: DataFrame, legs: Legs = Legs(), limit: int = 5) -> DataFrame:
    """source, path, project, date, time_ms, request, total: the newest sessions
    with what was asked last in them, and how many there are."""
    rows = search.visible(within(messages, legs))
    keys = ["source", "path"]
    grouped = rows.groupBy(*keys).agg(F.coalesce(F.max(_known(F.col("date"))), F.lit("")).alias("date"), F.max("time_ms").alias("time_ms"), F.max("project").alias("project"))
    if legs.since:
        grouped = grouped.filter(F.col("date") >= legs.since)
    newest = grouped.orderBy(F.desc("date"), F.desc_nulls_last("time_ms"), "source", "path").limit(limit)
    newest = newest.join(F.broadcast(grouped.agg(F.count("*").alias("total"))))  # one row
    mine = rows.join(F.broadcast(newest.select(*keys)), keys, "left_semi").filter((F.col("role") == "user") & T.is_prompt(F.col("text")))
    asked = mine.groupBy(*keys).agg(F.max_by("text", "seq").alias("text")).select(*keys, T.preview(T.trim(F.col("text"))).alias("request"))
    return newest.join(asked, keys, "left").select("source", "path", "project", "date", "time_ms", "request", "total")
