"""Text rules as Column expressions: case folding, lengths, trims, excerpts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# White space that prompts are trimmed of, as a regex class body.
TRIM_CLASS = r"\t\n\x0B\f\r    -     　﻿"

# Openings of user turns that a harness writes, not the user.
INJECTED_PREFIXES = (
    "# AGENTS.md instructions",
    "<INSTRUCTIONS>",
    "<environment_context>",
    "<user_instructions>",
    "<system-reminder>",
    "<command-name>",
    "<command-message>",
    "<local-command-stdout>",
    "<local-command-caveat>",
    "<task-notification>",
    "<system-notification>",
    "<fork-boilerplate>",
    "<project_instructions>",
    "<recommended_plugins>",
    "<skill ",
    "<skill>",
    "<bash-stdout>",
    "<bash-input>",
    "Caveat:",
    "[Request interrupted",
    "Base directory for this skill",
    "This session is being continued from a previous conversation",
    "[Compaction summary",
)

# Shapes of credentials, prefix and least length of the token.
SECRET_PREFIXES = (
    ("sk-", 24),
    ("AKIA", 20),
    ("ASIA", 20),
    ("AIza", 35),
    ("ghp_", 30),
    ("gho_", 30),
    ("ghs_", 30),
    ("github_pat_", 30),
    ("glpat-", 20),
    ("xoxb-", 20),
    ("xoxp-", 20),
    ("hf_", 30),
    ("eyJ", 40),
    ("tvly-", 20),
)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{TRIM_CLASS}]+|[{TRIM_CLASS}]+$", "")


def has(text: Column, term: str) -> Column:
    """Case-blind literal containment over all of Unicode."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping, case-blind."""
    low = F.lower(text)
    needle = term.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def ascii_occurrences(text: Column, term: str) -> Column:
    """Occurrences under ASCII folding; rows matched under full folding count one at least."""
    low = ascii_lower(text)
    counted = ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long")
    return F.greatest(F.lit(1).cast("long"), counted)


def _opening(prefix: str) -> str:
    """A prefix as a pattern; one that ends in white space has more behind it."""
    more = "" if prefix == prefix.rstrip() else f"(?=[\\s\\S]*[^{TRIM_CLASS}])"
    return re.escape(prefix) + more


#: What a trimmed text is or begins with if no person wrote it, in one pass.
_NOT_A_PROMPT = f"^[{TRIM_CLASS}]*(?:\\z|" + "|".join(_opening(p) for p in INJECTED_PREFIXES) + ")"


def is_prompt(text: Column) -> Column:
    """A user turn that a person wrote."""
    return ~text.rlike(_NOT_A_PROMPT)


def preview(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def snippet(text: Column, term: str, radius: int = 100) -> Column:
    """The first match with context and ``...`` where it is cut."""
    at = F.instr(F.lower(text), term.lower()) - 1
    start = F.greatest(F.lit(0), at - radius)
    end = F.least(F.length(text), at + len(term) + radius)
    body = F.substring(text, start + 1, end - start)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, 2 * radius)).otherwise(cut)


def excerpt(text: Column, terms: list[str], limit: int = 240) -> Column:
    """A window of ``limit`` characters around the earliest term, with ellipses."""
    low = F.lower(text)
    spots = F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.struct((F.instr(low, t.lower()) - 1).alias("at"), F.lit(k).alias("k"), F.lit(len(t)).alias("n"))) for k, t in enumerate(terms)])
    )
    first = F.array_min(spots)
    at, size = F.coalesce(first["at"], F.lit(0)), F.coalesce(first["n"], F.lit(0))
    length = F.length(text)
    lead = F.floor(F.greatest(F.lit(0), F.lit(limit) - (size + 2)) / 2).cast("int")
    start = F.least(F.greatest(F.lit(0), at - lead), F.greatest(F.lit(0), length - (limit - 1)))
    raw_end = F.least(start + limit - F.when(start > 0, 1).otherwise(0), length)
    end = F.when(raw_end < length, raw_end - 1).otherwise(raw_end)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < length, "…").otherwise(""))
    return F.when(length <= limit, text).otherwise(cut)


#: Follows a character of two UTF-16 units in ``units_of``; never part of a text.
HALF = "\uffff"


def units_of(text: Column) -> Column:
    """A text in which a position is a UTF-16 unit: characters of two units are
    followed by ``HALF``."""
    return F.regexp_replace(text, r"([\x{10000}-\x{10FFFF}])", f"$1{HALF}")


def _between(units: Column, start: Column, length: Column) -> Column:
    """A stretch of ``units_of`` as plain text, without a half character at its end."""
    cut = F.when(F.substring(units, start + length + 1, F.lit(1)) == HALF, length - 1).otherwise(length)
    return F.replace(F.substring(units, start + 1, F.greatest(F.lit(0), cut)), F.lit(HALF), F.lit(""))


def _aligned_lower(units: Column) -> Column:
    """Lower case, unit for unit: the one letter that grows loses its dot."""
    return F.lower(F.translate(units, "\u0130", "i"))


def first_spot(units: Column, terms: list[str]) -> Column:
    """struct(at, size): the earliest of the terms in ``units_of`` a text, or null."""
    wide = ["".join(c + HALF if ord(c) > 0xFFFF else c for c in t.replace("\u0130", "i")).lower() for t in terms if t]
    if not wide:
        return F.lit(None).cast("struct<at:int,size:int>")
    low = _aligned_lower(units)
    return F.array_min(F.array_compact(F.array(*[F.when(F.instr(low, w) > 0, F.struct((F.instr(low, w) - 1).alias("at"), F.lit(len(w)).alias("size"))) for w in wide])))


def cut_start(units: Column, total: Column, spot: Column, cap: Column) -> Column:
    """Where a cut of ``cap`` units around a spot begins, never inside a character;
    null without a spot."""
    room = F.greatest(F.lit(0), cap - 2 - spot["size"])
    begin = F.least(F.greatest(F.lit(0), spot["at"] - F.floor(room / 2).cast("int")), total - (cap - 1))
    return F.when(spot.isNotNull(), begin + F.when(F.substring(units, begin + 1, F.lit(1)) == HALF, 1).otherwise(0))


def cut_body(text: Column, units: Column, total: Column, begin: Column, cap: Column) -> Column:
    """struct(body, start) of a text cut at ``cut_start`` (null: at its beginning)."""
    lead = F.when(begin > 0, 1).otherwise(0)
    trail = F.when(total - begin > cap - lead, 1).otherwise(0)
    dots = lambda shown: F.when(shown == 1, "…").otherwise("")
    around = F.struct(F.concat(dots(lead), _between(units, begin, cap - lead - trail), dots(trail)).alias("body"), begin.alias("start"))
    bare = lambda body: F.struct(body.alias("body"), F.lit(0).alias("start"))
    return (
        F.when(total <= cap, bare(text))
        .when(begin.isNull(), bare(F.concat(_between(units, F.lit(0), F.greatest(F.lit(0), cap - 1)), F.lit("…"))))
        .when(cap < 3, bare(F.when(cap > 0, "…").otherwise("")))
        .otherwise(around)
    )


def clipped(text: Column, terms: list[str], cap: Column) -> Column:
    """struct(body, start): at most ``cap`` UTF-16 units of a text around the
    earliest of the terms (or its beginning), with ellipses where it is cut. One
    expression; over many rows take the parts as columns of their own."""
    units, limit = units_of(text), cap.cast("int")
    total = F.length(units)
    return cut_body(text, units, total, cut_start(units, total, first_spot(units, terms), limit), limit)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def looks_secret(text: Column) -> Column:
    tokens = F.split(text, "[^A-Za-z0-9_-]+")
    shaped = F.exists(tokens, lambda t: any_of((F.length(t) >= n) & F.startswith(t, F.lit(p)) for p, n in SECRET_PREFIXES))
    return (F.contains(text, F.lit("-----BEGIN")) & F.contains(text, F.lit("PRIVATE KEY"))) | shaped


def dated_since(date: Column, since: str) -> Column:
    """Dates from ``since`` on; undated rows always pass."""
    return (date >= since) | date.isin("", "unknown")


def project_matches(project: Column, needle: str, folded: Column | None = None) -> Column:
    """Substring, case-blind; where ``folded`` holds, hyphens also stand for slashes."""
    low = F.lower(project)
    plain = F.contains(low, F.lit(needle.lower()))
    if folded is None:
        return plain
    return plain | (folded & F.contains(F.translate(low, "-", "/"), F.lit(needle.lower().replace("-", "/"))))


def is_noise_path(path: Column) -> Column:
    return path.rlike(r"[/\\](subagents|tool-results|subagent-artifacts)[/\\]")


def is_error_output(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(Script failed|Error:|Process exited with code [1-9]|Exit code: [1-9])")


def is_observation(tool: Column) -> Column:
    return tool.rlike(r"(^|[._])(wait|write_stdin|sleep|wait_agent|clock__sleep)$")


def is_wrapper(tool: Column) -> Column:
    return tool.isin("exec", "functions.exec")
