"""Reading a conversation: neighbourhoods, gaps, pages, tails, packed excerpts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators.search import visible

MATCH_CAP = 8
LEAST_CHARS = 200
EVENT_ALLOWANCE = 200


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """Event numbers from 0 per session, given before any filter."""
    return events.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1)


def around(messages: DataFrame, anchors: DataFrame, context: int = 3) -> DataFrame:
    """path, seq, role, text, gap_before: messages within ``context`` of an
    anchor (path, seq), and how many are left out before each.

    Positions next to an anchor are listed and met by an equi-join."""
    visible_rows = visible(messages).withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1)
    at = visible_rows.join(anchors.select("path", "seq"), ["path", "seq"], "left_semi").select("path", "pos")
    near = at.select("path", F.explode(F.sequence(F.col("pos") - context, F.col("pos") + context)).alias("pos")).distinct()
    kept = visible_rows.join(near, ["path", "pos"])
    before = F.lag("pos", 1, -1).over(Window.partitionBy("path").orderBy("pos"))
    return kept.withColumn("gap_before", F.col("pos") - before - 1).select("path", "seq", "pos", "role", "text", "gap_before")


def tail(messages: DataFrame, turns: int = 12, budget: int = 8000, cap: int = 1500) -> DataFrame:
    """path, tail_start, kept, used: the newest run of messages within the
    budget, each counted at most at its cap; the newest is always kept."""
    rows = visible(messages)
    newest = Window.partitionBy("path").orderBy(F.desc("seq"))
    cost = F.least(T.utf16_length(F.col("text")), F.lit(min(cap, budget)))
    counted = rows.withColumn("cost", cost).withColumn("rn", F.row_number().over(newest)).withColumn("used", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = counted.filter((F.col("rn") == 1) | ((F.col("rn") <= turns) & (F.col("used") <= budget)))
    return kept.groupBy("path").agg(F.min("seq").alias("tail_start"), F.count("*").alias("kept"), F.max("used").alias("used"))


def densities(messages: DataFrame, terms: list[str], context: int = 2) -> DataFrame:
    """path, anchor, matches, chars of each neighbourhood, densest first by rank."""
    text = F.col("text")
    rows = visible(messages).filter((F.col("role") != "user") | T.is_prompt(text))
    weight = F.when(F.col("role") == "user", 2).otherwise(1)
    hits = sum((F.least(T.occurrences(text, t), F.lit(MATCH_CAP)) for t in terms), F.lit(0).cast("long")) * weight
    near = Window.partitionBy("path").orderBy("seq").rowsBetween(-context, context)
    measured = (
        rows.withColumn("hits", hits)
        .withColumn("size", F.greatest(T.utf16_length(text), F.lit(LEAST_CHARS)))
        .withColumn("matches", F.sum("hits").over(near))
        .withColumn("chars", F.sum("size").over(near))
        .filter("hits > 0")
    )
    # The ratio of two integers below 2^26 orders like the exact cross product.
    density = F.col("matches").cast("double") / F.col("chars")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(density.desc(), F.asc("seq")))
    return measured.select("path", F.col("seq").alias("anchor"), "matches", "chars", rank.alias("rank"))


def _measured(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Columns that every cut of a text shares, each computed once: its UTF-16
    units, how many, and the earliest of the terms."""
    rows = rows.withColumn("units_", T.units_of(F.col("text")))
    return rows.withColumn("total_", F.length("units_")).withColumn("spot_", T.first_spot(F.col("units_"), terms))


def _cut(rows: DataFrame, cap: Column, name: str) -> DataFrame:
    """A column struct(body, start) of measured texts cut to ``cap`` units."""
    rows = rows.withColumn("cap_", cap.cast("int"))
    rows = rows.withColumn("begin_", T.cut_start(F.col("units_"), F.col("total_"), F.col("spot_"), F.col("cap_")))
    body = T.cut_body(F.col("text"), F.col("units_"), F.col("total_"), F.col("begin_"), F.col("cap_"))
    return rows.withColumn(name, body).drop("cap_", "begin_")


def pages(events: DataFrame, start: int = 0, limit: int | None = None, cap: int | None = None, budget: int | None = None, focus: list[str] = ()) -> DataFrame:
    """path, idx, body, original_chars, start_char, clipped, next_event: the page
    of each session's events (path, idx, text), bodies clipped to the cap and to
    what is left of the budget; ``next_event`` is where the next page starts, or
    null.

    Only the first event that the budget cuts depends on the ones before, by the
    sum of their clipped lengths. What is left behind it (a unit, where a cut
    would have halved a character or there was no room for an ellipsis and
    more) goes to one more event.
    """
    huge = 1 << 30
    most, budget = min(cap or huge, budget or huge), budget or huge
    by_event = Window.partitionBy("path").orderBy("idx")
    rows = events.filter(F.col("idx") >= start).select("path", F.col("idx").cast("long").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(by_event))
    if limit:
        rows = rows.filter(F.col("place") <= limit + 1)
    rows = _cut(_measured(rows, list(focus)), F.lit(most), "whole_").withColumn("cost", T.utf16_length(F.col("whole_.body"))).drop("whole_")
    rows = (
        rows.withColumn("size", F.col("total_").cast("long"))
        .withColumn("left", F.lit(budget) - F.coalesce(F.sum("cost").over(by_event.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("short", F.least("size", F.lit(most)) > F.col("left"))
        .withColumn("first_short", F.min(F.when(F.col("short"), F.col("place"))).over(Window.partitionBy("path")))
        .withColumn("behind", F.col("place") - F.col("first_short"))
        .filter(F.col("behind").isNull() | (F.col("behind") <= 2))
    )
    rows = rows.withColumn("at_cut", F.greatest(F.lit(0), F.least(F.lit(most), F.col("left"))))
    rows = _cut(rows, F.col("at_cut"), "there_")
    rows = rows.withColumn("over", F.when(F.col("behind") == 0, F.col("left") - T.utf16_length(F.col("there_.body")))).drop("there_")
    rest = F.coalesce(F.lag("over").over(by_event), F.lit(0))
    rows = rows.withColumn("allowed", F.when(F.col("behind") == 1, rest).when(F.col("behind") == 2, 0).otherwise(F.col("at_cut")))
    rows = _cut(rows, F.col("allowed"), "body")
    shown = (F.col("allowed") > 0) & (F.col("place") <= (limit or huge))
    rows = rows.withColumn("next_event", F.min(F.when(~shown, F.col("idx"))).over(Window.partitionBy("path"))).filter(shown)
    return rows.select(
        "path", "idx", "body.body", F.col("size").alias("original_chars"), F.col("body.start").cast("long").alias("start_char"), (F.col("size") > F.col("allowed")).alias("clipped"), "next_event"
    )


def packed(messages: DataFrame, terms: list[str], budget: int, max_chars: int, context: int) -> DataFrame:
    """path, seq, n_kept: the events of each session that a budget has room for.

    Every neighbourhood lists its events: the anchor, then other anchors, then
    what is nearest. An event stands where it is listed first, and as many are
    kept as could be shown with ``LEAST_CHARS`` (or the cap) and an allowance each.
    """
    most = max(1, budget // (min(max_chars, LEAST_CHARS) + EVENT_ALLOWANCE))
    ranked = densities(messages, terms, context)
    base = visible(messages).filter((F.col("role") != "user") | T.is_prompt(F.col("text")))
    base = base.select("path", "seq", F.row_number().over(Window.partitionBy("path").orderBy("seq")).alias("pos"))
    base = base.join(ranked.select("path", F.col("anchor").alias("seq"), "rank"), ["path", "seq"], "left")
    # as many anchors as events fill the room by themselves
    near = base.filter(F.col("rank") <= most).select("path", F.col("seq").alias("anchor"), F.col("rank").alias("turn"), F.explode(F.sequence(F.col("pos") - context, F.col("pos") + context)).alias("pos"))
    listed = base.join(near, ["path", "pos"])
    order = F.struct("turn", F.col("seq") != F.col("anchor"), F.col("rank").isNull(), F.abs(F.col("seq") - F.col("anchor")), "seq")
    first = listed.groupBy("path", "seq").agg(F.min(order).alias("order"))
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("order"))).filter(F.col("place") <= most)
    return kept.select("path", "seq", F.count("*").over(Window.partitionBy("path")).alias("n_kept"))


def pack(messages: DataFrame, terms: list[str], budget: int = 12000, max_chars: int = 1200, context: int = 2, sessions: int = 3) -> DataFrame:
    """path, idx, body, original_chars: excerpts of the best sessions within a
    budget shared evenly, bodies clipped around the terms."""
    from threadlake.operators.find import relaxed

    best = relaxed(messages, terms, sessions)
    rows = messages.join(F.broadcast(best.select("path")), "path", "left_semi")  # ``sessions`` rows
    share = budget // sessions
    kept = packed(rows, terms, share, max_chars, context)
    each = F.least(F.lit(max_chars), F.floor(F.lit(share) / F.col("n_kept")))
    shown = _cut(_measured(rows.join(kept, ["path", "seq"]), terms), each, "cut")
    return shown.select("path", F.col("seq").cast("long").alias("idx"), F.col("cut.body").alias("body"), F.col("total_").cast("long").alias("original_chars"))


# Messages always shown at either end, what a message costs besides
# its text, characters a token, and the part of them that a window may fill.
BOOKENDS = 3
MESSAGE_COST = 20
CHARS_PER_TOKEN = 4
WINDOW_SHARE = 0.8


class Room:
    """What fits of a run of costs."""

    def __init__(self, limit: float, used: float = 0):
        self.limit, self.used = limit, used

    def take(self, cost: float, always: bool = False) -> bool:
        fits = always or self.used + cost <= self.limit
        self.used += cost * fits
        return fits


def _surely_shown(frame: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Of a conversation's ends and matches, ends first and matches from the
    best on: those shown, in which turn they were taken as a match, and what
    they cost in all. Both ends and the best match are shown whatever they cost."""
    room = Room(limit)
    ends = frame[frame["is_end"]]
    for cost in ends["cost"]:
        room.take(cost, always=True)
    turns: dict[int, int] = {}
    for pos, cost, is_end in frame[frame["score"] > 0].sort_values(["score", "pos"], ascending=[False, True])[["pos", "cost", "is_end"]].itertuples(index=False):
        if is_end or room.take(cost, always=not turns):
            turns[pos] = len(turns)
    shown = frame[frame["is_end"] | frame["pos"].isin(turns)]
    return shown[["path", "pos"]].assign(turn=shown["pos"].map(turns).astype("Int64"), used=float(room.used))


def _filled(frame: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Of a conversation's other messages those that still fit: first by their
    distance to the nearest match shown, as long as each distance adds one, then
    the earliest."""
    room = Room(limit, frame["used"].iloc[0])
    near = frame[frame["distance"].notna()].sort_values(["distance", "turn", "side"])
    taken, reached, grew = set(), 0, True
    for pos, cost, distance in near[["pos", "cost", "distance"]].itertuples(index=False):
        if distance > reached:
            if not (grew and distance == reached + 1 and room.used < limit):
                break
            reached, grew = distance, False
        if room.take(cost):
            taken.add(pos)
            grew = True
    for pos, cost in frame.sort_values("pos")[["pos", "cost"]].itertuples(index=False):
        if pos not in taken and room.take(cost):
            taken.add(pos)
    return frame.loc[frame["pos"].isin(taken), ["path", "pos"]]


def question_window(messages: DataFrame, words: list[str], token_budget: int) -> DataFrame:
    """path, seq: what of each conversation to show a model that takes
    ``token_budget`` tokens: all of it if it fits or has few messages, else a
    window of it.

    Windows rank the messages: the ends, the matches by score, and all others by
    their distance to the nearest match shown. Whether a message fits depends on
    all taken before it, which is a fold over lengths and ranks, a few bytes a
    message; texts do not go through it.
    """
    limit = token_budget * CHARS_PER_TOKEN * WINDOW_SHARE
    whole, order = Window.partitionBy("path"), Window.partitionBy("path").orderBy("seq")
    rows = visible(messages).select(
        "path",
        "seq",
        T.utf16_length(F.coalesce("text", F.lit(""))).alias("size"),
        sum((F.coalesce(T.has(F.col("text"), w), F.lit(False)).cast("int") for w in words), F.lit(0)).alias("score"),
    )
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("fits", (F.ceil(F.sum("size").over(whole) / CHARS_PER_TOKEN) <= token_budget) | (F.col("n") <= 2 * BOOKENDS + 2))
    kind = dict(messages.dtypes)["path"]
    long = rows.filter(~F.col("fits")).withColumn("cost", F.col("size") + MESSAGE_COST).withColumn("is_end", (F.col("pos") < BOOKENDS) | (F.col("pos") >= F.col("n") - BOOKENDS))
    sure = long.filter("is_end or score > 0").select("path", "pos", "cost", "score", "is_end")
    sure = sure.groupBy("path").applyInPandas(lambda f: _surely_shown(f, limit), f"path {kind}, pos long, turn long, used double")
    known = long.join(sure.withColumn("shown", F.lit(True)), ["path", "pos"], "left")
    at = Window.partitionBy("path").orderBy("pos")
    hub = F.when(F.col("turn").isNotNull(), F.struct("pos", "turn"))
    known = known.withColumn("before", F.last(hub, ignorenulls=True).over(at)).withColumn("after", F.first(hub, ignorenulls=True).over(at.rowsBetween(0, Window.unboundedFollowing)))
    ring = lambda h, side: F.when(h.isNotNull(), F.struct(F.abs(F.col("pos") - h["pos"]).alias("distance"), h["turn"].alias("turn"), F.lit(side).alias("side")))
    known = known.withColumn("ring", F.least(ring(F.col("after"), 0), ring(F.col("before"), 1))).withColumn("used", F.max("used").over(whole))
    others = known.filter("shown is null").select("path", "pos", "cost", "ring.*", "used")
    more = others.groupBy("path").applyInPandas(lambda f: _filled(f, limit), f"path {kind}, pos long")
    places = sure.select("path", "pos").unionByName(more)
    return rows.filter("fits").select("path", "seq").unionByName(long.join(places, ["path", "pos"]).select("path", "seq"))
