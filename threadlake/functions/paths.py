"""What a path or locator says: date, project, session, how to resume it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_of(path: Column) -> Column:
    """The first ISO date before a T, else sessions/Y/M/D, else ``unknown``."""
    iso = F.regexp_extract(path, r"([0-9]{4}-[0-9]{2}-[0-9]{2})T", 1)
    parts = r"sessions[/\\]([0-9]{4})[/\\]([0-9]{2})[/\\]([0-9]{2})"
    foldered = F.concat_ws("-", *[F.regexp_extract(path, parts, k) for k in (1, 2, 3)])
    return F.when(iso != "", iso).when(path.rlike(parts), foldered).otherwise("unknown")


def decode_project(folder: Column) -> Column:
    """A folder name that encodes a path with hyphens."""
    return F.replace(folder, F.lit("-"), F.lit("/"))


def compact_home(path: Column, home: str) -> Column:
    base = home.rstrip("/")
    rest = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return F.when(path == base, "~").when(F.startswith(path, F.lit(base + "/")), F.concat(F.lit("~"), rest)).otherwise(path)


def under(project: Column, folder: str) -> Column:
    return (project == folder) | F.startswith(project, F.lit(folder.rstrip("/") + "/"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.jsonl$", "")


def resume_command(source: Column, path: Column) -> Column:
    """The command that reopens a session, null where its name is not an id."""
    name = stem(path)
    rollout = F.regexp_extract(name, "rollout-.*-([0-9a-f-]{36})$", 1)
    opened = F.regexp_extract(path, "#(ses_[A-Za-z0-9_]+)$", 1)
    virtual = F.regexp_extract(path, "#([A-Za-z0-9_.:-]+)$", 1)
    return (
        F.when((source == "claude") & name.rlike("^[0-9a-f-]{36}$"), F.concat(F.lit("claude --resume "), name))
        .when((source == "codex") & (rollout != ""), F.concat(F.lit("codex resume "), rollout))
        .when(source == "pi", F.concat(F.lit("pi --session "), path))
        .when(source == "omp", F.concat(F.lit("omp --resume "), path))
        .when(source == "droid", F.concat(F.lit("droid --resume "), name))
        .when((source == "opencode") & (opened != ""), F.concat(F.lit("opencode2 -s "), opened))
        .when((source == "hermes") & (virtual != ""), F.concat(F.lit("hermes --resume "), virtual))
    )


def source_of(locator: Column) -> Column:
    """The agent a locator or log path belongs to."""
    scheme = F.regexp_extract(locator, "^(opencode|openclaw|hermes)://", 1)
    return (
        F.when(scheme != "", scheme)
        .when(locator.rlike(r"[/\\]\.claude[/\\]|[/\\]projects[/\\]"), "claude")
        .when(locator.rlike(r"[/\\]\.codex[/\\]|rollout-"), "codex")
        .when(locator.rlike(r"[/\\]\.omp[/\\]"), "omp")
        .when(locator.rlike(r"[/\\]\.pi[/\\]"), "pi")
        .when(locator.rlike(r"[/\\]\.factory[/\\]"), "droid")
        .when(locator.rlike(r"[/\\]\.gemini[/\\]"), "agy")
    )


def percent_decode(text: Column) -> Column:
    """%XX as bytes of UTF-8; what is no such pair stays, and so does a plus."""
    pairs = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(pairs, F.lit("+"), F.lit("%2B")))


# Characters that a component of an address may hold as they are,
# next to letters, digits and those that ``url_encode`` leaves.
PLAIN = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~", "+": "%20"}


def encode_component(text: Column) -> Column:
    out = F.url_encode(text)
    for coded, plain in PLAIN.items():
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def decode_component(text: Column) -> Column:
    """Null where a percent sign is not followed by two hex digits."""
    return F.when(~text.rlike("%(?![0-9A-Fa-f]{2})"), percent_decode(text))
