"""Notes: keyword search, chunks, vectors and their fusion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from threadlake.functions import text as T
from threadlake.functions.order import total_order

FLOOR, MARGIN, FUSION_K = 0.65, 0.06, 60
CHUNK_TARGET, CHUNK_MOST = 1600, 4000
GATE = "do not read unless"


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def projects(notes: DataFrame) -> DataFrame:
    return notes.groupBy("project").agg(F.count("*").alias("files"))


def keyword(notes: DataFrame, query: str, limit: int = 20, project: str | None = None, kind: str | None = None) -> DataFrame:
    """path, count, score, rank: notes that hold every term."""
    terms = terms_of(query)
    low = F.lower("text")
    kept = notes.filter(T.all_of(F.contains(low, F.lit(t)) for t in terms))
    if project:
        kept = kept.filter(T.project_matches(F.col("project"), project))
    if kind:
        kept = kept.filter(F.lower("type") == kind.lower())
    each = [T.occurrences(F.col("text"), t) for t in terms]
    label = F.lower(F.concat_ws(" ", F.col("path").cast("string"), *[F.col(c) for c in ("name",) if c in notes.columns]))
    about = F.lower("description") if "description" in notes.columns else F.lit("")
    score = sum((4 * F.contains(label, F.lit(t)).cast("int") + 2 * F.contains(about, F.lit(t)).cast("int") + F.least(n, F.lit(5)) for t, n in zip(terms, each)), F.lit(0))
    if len(terms) > 1:
        score = score + 5 * F.contains(low, F.lit(" ".join(terms))).cast("int")
    scored = kept.select("path", "project", sum(each, F.lit(0)).cast("long").alias("count"), score.cast("long").alias("score"))
    named = total_order(F.col("path")) if isinstance(scored.schema["path"].dataType, StringType) else F.col("path")
    order = [F.desc("score"), F.desc("count"), named]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # ``limit`` rows


def line_snippets(notes: DataFrame, query: str, per_note: int = 3) -> DataFrame:
    """path, n, line: lines with the most distinct terms, in order."""
    terms = terms_of(query)
    hits = lambda line: sum((F.contains(F.lower(line), F.lit(t)).cast("int") for t in terms), F.lit(0))
    scored = F.transform(F.split("text", "\n", -1), lambda line, k: F.struct((-hits(line)).alias("less"), k.alias("k"), line.alias("line")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["less"] < 0)), 1, per_note)
    kept = notes.filter(T.all_of(F.contains(F.lower("text"), F.lit(t)) for t in terms))
    return kept.select("path", F.posexplode(best).alias("n", "s")).select("path", "n", F.col("s.line").alias("line"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vec: Column) -> Column:
    norm = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: (x / norm).cast("float"))


def similarities(chunks: DataFrame, query_vec: list[float]) -> DataFrame:
    """Exact cosine of every chunk; the query is a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    return chunks.withColumn("sim", F.round(dot(F.col("vec"), q), 6))


def nearest(chunks: DataFrame, query_vec: list[float], limit: int = 20, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """path, id, sim, rank: each note's best chunk, near the best of all.

    Filter the chunks before this: the margin is taken from the best that is left.
    """
    best = similarities(chunks, query_vec).groupBy("path").agg(F.max_by(F.struct("id", "sim"), F.struct(F.col("sim"), -F.col("id"))).alias("b")).select("path", "b.id", "b.sim")
    top = best.agg(F.max("sim").alias("top"))
    near = best.join(F.broadcast(top), F.col("sim") >= F.greatest(F.lit(floor), F.col("top") - margin)).drop("top")  # one row
    order = [F.desc("sim"), F.asc("path")]
    return near.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(words: DataFrame, vectors: DataFrame, limit: int = 20) -> DataFrame:
    """path, score, match: reciprocal ranks of both lists; ties keep keyword hits first."""
    both = words.select("path", F.col("rank").alias("kr")).join(vectors.select("path", F.col("rank").alias("vr")), "path", "full_outer")
    part = lambda c: F.coalesce(1 / (FUSION_K + F.col(c)), F.lit(0.0))
    kind = F.when(F.col("kr").isNull(), "semantic").when(F.col("vr").isNull(), "keyword").otherwise("both")
    scored = both.select("path", F.round(part("kr") + part("vr"), 9).alias("score"), kind.alias("match"))
    return scored.orderBy(F.desc("score"), (F.col("match") == "semantic").asc(), F.asc("path")).limit(limit)


def content_sha(title: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, text), 256)


def chunk_diff(known: DataFrame, new: DataFrame) -> DataFrame:
    """path, sha, action: keep, add or delete, by content within each note."""
    k = known.groupBy("path", "sha").agg(F.count("*").alias("had"))
    n = new.groupBy("path", "sha").agg(F.count("*").alias("has"))
    action = F.when(F.col("had").isNull(), "add").when(F.col("has").isNull(), "delete").otherwise("keep")
    return k.join(n, ["path", "sha"], "full_outer").select("path", "sha", action.alias("action"))


def queue_counts(queue: DataFrame) -> DataFrame:
    """Chunks per status and batches in flight."""
    states = ("pending", "submitted", "retry", "done", "failed", "withheld")
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states], F.count_distinct(F.when(F.col("status") == "submitted", F.col("batch_id"))).alias("batches"))


def store_vectors(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Results land only where id, content and status still match."""
    ok = results.select("id", "sha", F.col("vec").alias("new_vec"))
    joined = queue.join(ok, ["id", "sha"], "left")
    landed = F.col("new_vec").isNotNull() & (F.col("status") == "submitted")
    return joined.withColumn("vec", F.when(landed, F.col("new_vec")).otherwise(F.col("vec"))).withColumn("status", F.when(landed, "done").otherwise(F.col("status"))).drop("new_vec")


def match_batch(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Results of a batch (batch_id, pos, vec) to the chunks they were sent for."""
    return queue.select("id", "sha", "batch_id", "pos").join(results, ["batch_id", "pos"]).select("id", "sha", "vec")


def invalidate(queue: DataFrame, model: str, dims: int) -> DataFrame:
    """Chunks of another model or size go back to pending, without their vectors."""
    stale = (F.col("status") != "withheld") & ((F.col("model") != model) | (F.col("dims") != dims))
    return queue.withColumn("vec", F.when(~stale, F.col("vec"))).withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def requeue_failed(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def frontmatter(text: str) -> dict:
    """Top fields of a note's header: plain values, folded blocks, lists."""
    lines = text.split("\n")
    out: dict = {"body_start": 0}
    if not lines or lines[0].strip() != "---":
        return out
    end = next((k for k, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if end is None:
        return out
    key = None
    for line in lines[1:end]:
        field = re.match(r"\s*([A-Za-z_]+):\s*(.*)$", line)
        if field and not line.startswith((" ", "\t")) or field and key == "metadata":
            name, value = field[1].lower(), field[2].strip()
            if name == "metadata":
                key = name
                continue
            if not line.startswith((" ", "\t")):
                key = name
            if value.startswith("[") and value.endswith("]"):
                out[name] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()]
            else:
                out[name] = "" if value in (">", "|", ">-", "|-") else value.strip("'\"")
        elif key and line.strip().startswith("- "):
            out[key] = [*(out[key] if isinstance(out.get(key), list) else []), line.strip()[2:].strip("'\"")]
        elif key and line.strip() and isinstance(out.get(key), str):
            out[key] = f"{out[key]} {line.strip()}".strip()
    out["body_start"] = end + 1
    return out


def is_gated(name: str, text: str) -> str | None:
    """Why a note is never indexed: it is the index page, or it says so."""
    if name == "MEMORY.md":
        return "index"
    front = frontmatter(text)
    fields = " ".join(str(front.get(f, "")) for f in ("name", "description", "title", "summary"))
    if GATE in name.lower() or GATE in " ".join(fields.lower().split()) or "gated" in front:
        return "gated"
    return None


def holds_secret(text: str) -> bool:
    """``T.looks_secret`` of one string."""
    shaped = (len(t) >= n and t.startswith(p) for t in re.split(r"[^A-Za-z0-9_-]+", text) for p, n in T.SECRET_PREFIXES)
    return ("-----BEGIN" in text and "PRIVATE KEY" in text) or any(shaped)


def split_note(title: str, text: str) -> list[tuple[str, str]]:
    """(title, text) chunks: sections at headings, packed from blocks at blank
    lines up to the target; fenced code is not cut at blank lines; blocks over
    the limit are cut, unless they hold a credential."""
    body = text.split("\n")[frontmatter(text)["body_start"] :]
    sections: list[tuple[str, list[str]]] = [(title, [])]
    fenced = False
    for line in body:
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if not fenced and (head := re.match(r"#{1,6}\s+(.*)$", line)):
            sections.append((f"{title} › {head[1].strip()}", []))
        else:
            sections[-1][1].append(line)
    out = []
    for name, lines in sections:
        blocks, block, fenced = [], [], False
        for line in [*lines, ""]:
            if line.lstrip().startswith("```"):
                fenced = not fenced
            if not line.strip() and not fenced:
                if block:
                    blocks.append("\n".join(block))
                block = []
            else:
                block.append(line)
        if block:
            blocks.append("\n".join(block))
        held = ""
        # a block with a credential stays whole, so that no part of it escapes the filter
        for b in (piece for b in blocks for piece in ([b] if holds_secret(b) else (b[k : k + CHUNK_MOST] for k in range(0, len(b), CHUNK_MOST)))):
            if held and len(held) + len(b) + 2 > CHUNK_TARGET:
                out.append((name, held))
                held = b
            else:
                held = f"{held}\n\n{b}" if held else b
        if held:
            out.append((name, held))
    return out


CHUNKS = "path string, chunk_no int, title string, text string, sha string, withheld boolean"


def chunk_notes(notes: DataFrame) -> DataFrame:
    """Chunks of notes (path, name, text); gated notes give none, chunks that
    look like they hold a credential are withheld."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, name, text in frame[["path", "name", "text"]].itertuples(index=False):
                if is_gated(name, text or ""):
                    continue
                for k, (title, body) in enumerate(split_note(frontmatter(text).get("name") or name, text)):
                    rows.append((path, k, title, body, hashlib.sha256(f"{title}\n{body}".encode()).hexdigest(), False))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return notes.select("path", "name", "text").mapInPandas(run, CHUNKS).withColumn("withheld", T.looks_secret(F.col("text")))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors from a pluggable embedder; withheld chunks are never sent."""
    schema = StructType([*chunks.schema.fields, StructField("vec", ArrayType(FloatType()))])

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(vec=embedder(frame["text"].tolist()))

    return chunks.filter(~F.col("withheld")).mapInPandas(run, schema)
