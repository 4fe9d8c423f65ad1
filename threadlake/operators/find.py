"""Multi-term session finder with relaxed AND, and its keyword front."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from threadlake.functions import text as T
from threadlake.operators.search import visible

CANDIDATES = 40
USER_WEIGHT, ASSISTANT_WEIGHT = 5, 1
MAX_KEYWORDS = 6

# Words that carry no signal in a description of a session.
STOPWORDS = frozenset(
    (
        "about", "after", "again", "all", "also", "and", "any", "are", "been", "before", "being", "but", "can", "chat", "conversation", "could",
        "did", "does", "doing", "done", "earlier", "for", "from", "had", "has", "have", "how", "into", "its", "just", "last", "made", "make", "not",
        "one", "our", "out", "over", "previous", "remember", "session", "sessions", "should", "some", "talked", "than", "that", "the", "their",
        "them", "then", "there", "these", "they", "thing", "things", "this", "those", "time", "was", "were", "what", "when", "where", "which",
        "while", "who", "why", "will", "with", "worked", "would", "you", "your",
    )
)


def distinct_terms(terms: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for term in (t.strip() for t in terms):
        if term:
            seen.setdefault(term.lower(), term)
    return list(seen.values())


def parse_since(since: str, today: date) -> str:
    """A date, or an age: days, weeks, months of 30 days."""
    if m := re.fullmatch(r"([0-9]+)([dwm])", since.strip()):
        return (today - timedelta(days=int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]])).isoformat()
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", since.strip()):
        return since.strip()
    raise ValueError(f"not a date or an age: {since}")


def keywords(description: str, extra: list[str] = ()) -> list[str]:
    """Given terms first, then the longest words of the description."""
    out = distinct_terms(list(extra))
    seen = {t.lower() for t in out}
    words = []
    for raw in re.split(r"[^\w\-./]+", description):
        word = raw.strip("-_./").lower()
        if len(word) >= 3 and not re.fullmatch("[0-9]+", word) and word not in STOPWORDS and word not in seen:
            seen.add(word)
            words.append(word)
    return out + sorted(words, key=len, reverse=True)[:MAX_KEYWORDS]


def _per_term(messages: DataFrame, terms: list[str]) -> DataFrame:
    """One pass: per session and term the hits by role, as columns u0, a0, u1, ..."""
    text = F.col("text")
    prompt = F.col("role") != "user"
    prompt = prompt | T.is_prompt(text)
    rows = visible(messages).filter(T.any_of(T.has(text, t) for t in terms)).filter(prompt)
    counts = []
    for k, term in enumerate(terms):
        counts.append(F.count_if(T.has(text, term) & (F.col("role") == "user")).alias(f"u{k}"))
        counts.append(F.count_if(T.has(text, term) & (F.col("role") == "assistant")).alias(f"a{k}"))
    dates = [F.max(F.when(F.col("date").isin("", "unknown"), "").otherwise(F.col("date"))).alias("date")] if "date" in messages.columns else []
    return rows.groupBy("path").agg(*counts, *dates)


def term_scores(messages: DataFrame, terms: list[str]) -> DataFrame:
    """path, term, user_count, assistant_count, score per session and term."""
    terms = distinct_terms(terms)
    wide = _per_term(messages, terms)
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"u{k}").alias("user_count"), F.col(f"a{k}").alias("assistant_count")) for k, t in enumerate(terms)])
    long = wide.select("path", F.inline(rows)).filter("user_count + assistant_count > 0")
    return long.withColumn("score", USER_WEIGHT * F.col("user_count") + ASSISTANT_WEIGHT * F.col("assistant_count"))


def candidates(messages: DataFrame, terms: list[str], user_only: bool = False) -> DataFrame:
    """path, n_terms, min_count, total, score, matched, truncated: at most
    ``CANDIDATES`` sessions by terms matched, least count, total, path."""
    terms = distinct_terms(terms)
    wide = _per_term(messages, terms)
    each = [F.col(f"u{k}") + (F.lit(0) if user_only else F.col(f"a{k}")) for k in range(len(terms))]
    present = F.filter(F.array(*each), lambda n: n > 0)
    users, others = sum((F.col(f"u{k}") for k in range(len(terms))), F.lit(0)), sum((F.col(f"a{k}") for k in range(len(terms))), F.lit(0))
    scored = wide.select(
        "path",
        F.size(present).alias("n_terms"),
        F.array_min(present).alias("min_count"),
        F.aggregate(present, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        (USER_WEIGHT * users + (F.lit(0) if user_only else ASSISTANT_WEIGHT * others)).alias("score"),
        F.array_compact(F.array(*[F.when(n > 0, F.lit(t)) for n, t in zip(each, terms)])).alias("matched"),
        *([F.col("date")] if "date" in wide.columns else []),
    ).filter("n_terms > 0")
    order = [F.desc("n_terms"), F.desc("min_count"), F.desc("total"), F.asc("path")]
    capped = scored.orderBy(*order).limit(CANDIDATES + 1)
    return capped.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.max("place").over(Window.partitionBy()) > CANDIDATES).filter(F.col("place") <= CANDIDATES).drop("place")


def relaxed(messages: DataFrame, terms: list[str], limit: int = 5, user_only: bool = False) -> DataFrame:
    """path, score, matched: hits that match all terms the best hit matches; of
    equal hits the newer first, where messages have a date."""
    ranked = candidates(messages, terms, user_only)
    order = [F.desc("n_terms"), F.desc("score"), *([F.desc("date")] if "date" in ranked.columns else []), F.asc("path")]
    required = F.first("matched").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # 40 rows at most
    kept = ranked.withColumn("required", required).filter(F.size(F.array_except("required", "matched")) == 0)
    return kept.orderBy(*order).limit(limit).select("path", "score", F.array_join("matched", "|").alias("matched"), F.array_join("required", "|").alias("required"))


def within_long_terms(messages: DataFrame, terms: list[str]) -> DataFrame:
    """Scores where terms under three characters only count in sessions that a
    longer term has found (a semi join)."""
    terms = distinct_terms(terms)
    long = [t for t in terms if len(t) >= 3]
    scores = term_scores(messages, terms)
    if not long or len(long) == len(terms):
        return scores
    found = scores.filter(F.col("term").isin(*long)).select("path").distinct()
    return scores.join(found, "path", "left_semi")


def opening_prompts(messages: DataFrame) -> DataFrame:
    """path, opening: the first prompt a person wrote, as a preview."""
    prompts = messages.filter((F.col("role") == "user") & T.is_prompt(F.col("text")))
    return prompts.groupBy("path").agg(F.min_by("text", "seq").alias("text")).select("path", T.preview(T.trim(F.col("text"))).alias("opening"))


def last_requests(messages: DataFrame) -> DataFrame:
    """path, seq, request: the newest prompt a person wrote, as a preview."""
    prompts = messages.filter((F.col("role") == "user") & T.is_prompt(F.col("text")))
    newest = prompts.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))
    return newest.select("path", "seq", T.preview(T.trim(F.col("text"))).alias("request"))


def activity(messages: DataFrame) -> DataFrame:
    """path, date: newest date; a session whose newest is unknown has none."""
    newest = messages.groupBy("path").agg(F.max("date").alias("date"))
    return newest.withColumn("date", F.when(F.col("date") != "unknown", F.col("date")))


def recall(messages: DataFrame, description: str, extra: list[str] = (), limit: int = 30) -> DataFrame:
    """path, n_keywords, score: candidates over the keywords of a description; of
    equal ones the newer first, where messages have a date."""
    words = keywords(description, extra)
    wide = _per_term(messages, distinct_terms(words))
    users, others = [c for c in wide.columns if c[0] == "u"], [c for c in wide.columns if c[0] == "a"]
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    met = sum(((F.col(u) + F.col(a) > 0).cast("long") for u, a in zip(users, others)), F.lit(0).cast("long"))
    merged = wide.select("path", met.alias("n_keywords"), (USER_WEIGHT * total(users) + ASSISTANT_WEIGHT * total(others)).alias("score"), *([F.col("date")] if "date" in wide.columns else []))
    order = [F.desc("n_keywords"), F.desc("score"), *([F.desc("date")] if "date" in merged.columns else []), F.asc("path")]
    return merged.filter("n_keywords > 0").orderBy(*order).limit(limit).select("path", "n_keywords", "score")


def judged(candidates: DataFrame, judge, threshold: float = 0.2, limit: int = 5, batch: int = 10) -> DataFrame:
    """Relevance from a pluggable judge: ``judge(rows) -> list of floats`` over
    batches of candidate rows; candidates are few by construction."""
    schema = StructType([*candidates.schema.fields, StructField("relevance", DoubleType())])

    def run(frames):
        for frame in frames:
            rows = frame.to_dict("records")
            values = [v for at in range(0, len(rows), batch) for v in judge(rows[at : at + batch])]
            yield frame.assign(relevance=values)

    return candidates.mapInPandas(run, schema).filter(F.col("relevance") >= threshold).orderBy(F.desc("relevance"), F.asc("path")).limit(limit)
