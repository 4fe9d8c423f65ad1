"""Secret scan through a trigram inverted index.

The index stores every trigram of every text (in lower case) with the document
it is in: a segment per task, sorted by trigram and cut into small pages. A
lookup names its trigrams in filters that the scan can hold against the pages'
bounds, so of each segment it reads the pages of its trigrams alone. The index
knows nothing of the rules and serves any others.

Each rule's regular expression yields a Boolean trigram query: conditions that
must all hold, each with alternatives, each of several trigrams. Postings of an
alternative are intersected by counting distinct trigrams per document,
alternatives are united, conditions are intersected again, and only documents so
found are run through the rule's expression. A rule without a mandatory trigram
scans every text. All of it is SQL functions: spans come from cutting a text at
its matches and adding up the lengths of the pieces.

Scale: texts are read twice and not shuffled as long as the candidate table's
counted size allows a broadcast; beyond ``MAX_BROADCAST_ROWS`` candidates the
join runs shuffled on the id.

Edge cases: a null text is empty and has no spans; rows that share an id share
candidates but are verified each by itself; matches that fail a rule's length
are dropped without another try inside them; a document without spans has the
empty string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm import trigrams
from threadlake.session import concluded, materialize

MAX_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group has at least ``least``
    characters; ``any_case`` folds ASCII letters; ``at_least`` is an equal
    expression that only matches long enough runs, where one exists."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    at_least: str = ""

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.at_least or self.pattern)


BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, at_least=r"[0-9a-f]{32,}"),
)
#: Public formats beyond the base kinds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


#: Rows of a page of the index: what a lookup reads around a short list.
PAGE_ROWS = 2000

#: Every place of a text with its three characters.
ALL_TRIGRAMS = r"(?s)(?=(...))"


def trigram_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (trigram, doc_id), each once a row, sorted by trigram in
    each segment."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(ALL_TRIGRAMS), F.lit(1)))
    # explode would test the list for being empty first, and so build it twice
    postings = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(held).alias("trigram")).filter("trigram is not null")
    sorted_rows = postings.select("trigram", "doc_id").sortWithinPartitions("trigram")
    return materialize(sorted_rows, "trigram-index", **{"parquet.page.row.count.limit": str(PAGE_ROWS)})


def lookup(index: DataFrame, wanted: list[str]) -> DataFrame:
    """The postings of the wanted trigrams. A list longer than the scan's
    threshold would be pushed down as its least and greatest value alone, so it
    is asked for in short lists."""
    size = max(1, int(index.sparkSession.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")))
    lists = [F.col("trigram").isin(wanted[k : k + size]) for k in range(0, len(wanted), size)]
    return index.filter(reduce(Column.__or__, lists, F.lit(False)))


def scanning(rules) -> int:
    """The bits of the rules that have to scan every text."""
    return sum(1 << k for k, r in enumerate(rules) if not trigrams.query(r.pattern))


def candidates(index: DataFrame, rules) -> DataFrame:
    """(doc_id, rules as bits) of documents whose postings satisfy a rule's query."""
    asked = [
        (k, len(q), c, n, len(clause), t)
        for k, q in enumerate(trigrams.query(r.pattern) for r in rules)
        for c, condition in enumerate(q)
        for n, clause in enumerate(condition)
        for t in sorted(clause)
    ]
    wanted = sorted({a[5] for a in asked})
    table = index.sparkSession.createDataFrame(asked, "rule int, conditions int, condition int, clause int, size int, trigram string")
    return (
        lookup(index, wanted)
        .join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
        .groupBy("doc_id", "rule", "conditions", "condition", "clause", "size")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter("n = size")
        .groupBy("doc_id", "rule", "conditions")
        .agg(F.count_distinct("condition").alias("n"))
        .filter("n = conditions")
        .groupBy("doc_id")
        .agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("bits"))
    )


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's kept matches."""
    pattern = F.lit(rule.java)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.arrays_zip(F.transform(F.split(text, rule.java, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("length"), measured.alias("held"))
    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        end = start + F.coalesce(piece["length"], F.lit(0))
        keep = F.coalesce(F.length(piece["held"]) >= rule.least, F.lit(False))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, empty, step, lambda acc: acc["spans"])


def _named(kind_no: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _of_kind(kind_no: int):
    return lambda s: s["kind_no"] == kind_no


def scan(docs: DataFrame, base=BASE_RULES, more=MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, per row, ``found``: array<struct<start, kind_no, end, kind>> in order."""
    rules = (*base, *more)
    everywhere = scanning(rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = F.lit(everywhere).cast("long")
    if everywhere != (1 << len(rules)) - 1:
        found = concluded(docs.sparkSession, "secret-candidates", lambda: candidates(trigram_index(docs, id_col, text_col), rules)).withColumnRenamed("doc_id", "id__")
        if found.count() <= MAX_BROADCAST_ROWS:
            found = F.broadcast(found)
        rows = rows.join(found, rows["doc_id"].eqNullSafe(found["id__"]), "left").drop("id__")
        bits = F.coalesce("bits", F.lit(0).cast("long")).bitwiseOR(bits)
    rows = rows.withColumn("bits", bits)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    spans = []
    for k, rule in enumerate(rules):
        asked = F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0
        if everywhere >> k & 1:
            asked = F.col("text").rlike(rule.java)
        one = F.when(asked, _spans(F.col("text"), rule)).otherwise(none)
        spans.append(F.transform(one, _named(k, rule.kind)))
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def describe(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE_RULES))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(write(base), 256).alias("base_sha256"), write(F.col("found")).alias("spans"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return describe(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _rule_sql(k: int, rule: Rule) -> str:
    pattern = rule.java.replace("'", "''")
    return f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, g[i] AS held, length(m[i]) AS n,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (
    SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g, regexp_split_to_array(text, '{pattern}') AS p
      FROM t WHERE regexp_matches(text, '{pattern}')))
  WHERE length(held) >= {rule.least}"""


_ALL_RULES = (*BASE_RULES, *MORE_RULES)
OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(_ALL_RULES))}),
w AS (SELECT doc_id, k, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS span FROM s),
a AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))},
    string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
  FROM w GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""
