"""Quality rules as a ledger of bits.

Every rule is evaluated once per text, in one pass; what is stored per document
is the measurements and one integer whose bit k says that rule k failed. A
policy is a named mask over those bits, so a new policy, a comparison of
policies or an ablation reads the small ledger and never the texts again.

Measurements (words are runs of characters other than space and \\t..\\r):
n_words; word_chars, code points inside words; n_symbols, characters of
``#*$%&|<>``; n_lines, lines with a word; n_dup_lines, those equal to an earlier
line of the text; n_repeat_words, words in five-word windows that stand twice
or more in the text, the first included.

Edge cases: a null text has no words and fails ``few_words``; an empty or blank
text likewise; repeated rows are judged alike, one by one; an empty table gives
an empty ledger; extra columns are ignored, and clashing ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm import worker
from threadlake.llm.mixing import fresh
from threadlake.llm.textgrid import grids, seen_before
from threadlake.session import bound_batches, materialize

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

Measured = Callable[[str], Column]

#: Rule k fails where its condition over the measurements holds; the order
#: fixes the bits and may only be added to.
RULES: dict[str, Callable[[Measured], Column]] = {
    "few_words": lambda m: m("n_words") < 10,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "symbols_over_words": lambda m: m("n_symbols") > 2 * m("n_words"),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 40 * m("n_words"),
    "repeated_lines": lambda m: (m("n_lines") >= 5) & (100 * m("n_dup_lines") > 60 * m("n_lines")),
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def failures(m: Measured) -> Column:
    """The ledger's bits, every rule evaluated once."""
    return reduce(Column.bitwiseOR, (F.when(rule(m), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()))


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _measure(texts: pa.Array) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for _, g in grids(texts):
        newline = np.flatnonzero(g.raw == 10)
        begin = np.sort(np.concatenate([g.starts, newline + 1]))
        end = np.sort(np.concatenate([g.ends, newline]))
        full = np.concatenate([[0], np.cumsum(g.solid)])
        has_word = full[end] > full[begin]
        begin, end = begin[has_word], end[has_word]
        doc = np.searchsorted(g.ends, begin, side="right")
        earlier, _ = seen_before(doc, g.hashes(begin, end))
        first, wdoc, code = g.windows()
        _, again = seen_before(wdoc, code)
        cover = np.zeros(len(g.word_start) + 1, dtype=np.int64)
        np.add.at(cover, first[again], 1)
        np.add.at(cover, first[again] + 5, -1)
        repeated = np.cumsum(cover[:-1]) > 0
        count = lambda at: np.bincount(at, minlength=g.n_docs)
        for part, value in zip(
            parts,
            (
                g.n_words,
                g.per_doc(g.solid & ~((g.raw & 0xC0) == 0x80)),
                g.per_doc(SYMBOLS[g.raw]),
                count(doc),
                count(doc[earlier]),
                count(g.word_doc[repeated]),
            ),
        ):
            part.append(value)
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``, the bits of the rules that failed."""
    names = ["doc_id", *(m.split()[0] for m in MEASURES.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            yield pa.record_batch([batch.column(0), *(pa.array(v, pa.int64()) for v in _measure(batch.column(1)))], names)

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {MEASURES}").withColumn("failed", failures(F.col))


def passes(policy: str, failed: Column | None = None) -> Column:
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it fails, and those it alone rejects."""
    held = rows.withColumn("hit", F.col("failed").bitwiseAND(F.lit(mask(policy))))
    counts = [F.count_if(F.col("hit").bitwiseAND(F.lit(BIT[r])) != 0).alias(f"{r}__fails") for r in POLICIES[policy]]
    counts += [F.count_if(F.col("hit") == BIT[r]).alias(f"{r}__alone") for r in POLICIES[policy]]
    one = held.agg(*counts)
    pairs = ", ".join(f"'{r}', {r}__fails, {r}__alone" for r in POLICIES[policy])
    return one.selectExpr(f"stack({len(POLICIES[policy])}, {pairs}) as (rule, n_failed, n_alone)")


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, all columns kept.

    The row's ledger entry rides along as one more column: its bits are built as
    in ``ledger`` and the policy's mask decides, so each row is judged by itself
    and no text is shuffled.
    """
    bound_batches(docs.sparkSession)
    name = fresh("quality", docs.columns)
    inner = T.StructType([T.StructField(m.split()[0], T.LongType()) for m in MEASURES.split(", ")])
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in _measure(batch.column(at))], inner.fieldNames())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    measured = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, inner)]))
    entry = failures(lambda field: F.col(f"`{name}`.{field}"))
    return measured.filter(passes(policy, entry)).drop(name)


def op3_quality_ledger(spark, sf_dir: str) -> DataFrame:
    rows = materialize(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-ledger")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed"
    )


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 fails, and what it alone rejects."""
    return ablation(materialize(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-ledger"), "v1")


_LEDGER_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, shingle) AS n FROM g), (SELECT unnest(range(0, 5)) AS k)
  WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_lines >= 5 AND 100 * n_dup_lines > 60 * n_lines THEN 32 ELSE 0 END AS failed
  FROM m
)
"""
OP3_SQL = (
    _LEDGER_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed
FROM b
"""
)
ABLATION_SQL = (
    _LEDGER_SQL
    + "SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_alone FROM b, (VALUES "
    + ", ".join(f"('{rule}', {BIT[rule]})" for rule in POLICIES["v1"])
    + ") r(rule, bit) GROUP BY rule"
)
