"""Benchmark decontamination on a distributed positional inverted index.

The index stores every posting of every term: (term, row, position). It is made
of immutable segments, one per task of the input and sorted by term: within a
segment a term's list stands in one piece, and a frequent word's list is spread
over all segments. Nothing is shuffled to build it. It knows nothing of the test
set and serves any other one.

A query over test phrases reads lists in order of rarity: document frequencies
rank each phrase's terms; the lists of its rarest terms, shifted by their offset
in the phrase, are intersected by counting hits per (phrase, row, start); what
is left is checked against the phrase's other terms. Near matches (all terms
within a span, in any order) start from the same lists: a posting of the rarest
term must have one of the next rarest nearby before the others are looked up.

Terms are compared by 64-bit hashes; two different ones agree with odds of about
2^-64.

Scale: texts are cut into words once and never shuffled. The tables sent to all
tasks are made from the test set or name candidate rows, and are counted first:
above ``MAX_BROADCAST_ROWS`` rows the same joins run shuffled. No other table
passes through the driver, whatever size the session lets Spark broadcast by
itself. Candidate rows are pre-summed before they are shuffled.

Edge cases: null or wordless texts have no words, no hits and are clean; a null
item id is the empty string; repeated documents are each judged, and repeated
items or equal windows of several items all count their item ids; an item of
one to twelve words is one window; empty tables give empty or clean results;
extra columns are ignored, and kept by ``clean_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import concluded, materialize

WINDOW_WORDS = 13
RAREST = 3
MAX_BROADCAST_ROWS = 500_000
CONTAMINATED_ONE_IN = 20
NEAR_SPAN = 26
DOCUMENT_MARK = "\x00document"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words in a text whose letters A-Z are not yet lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    """Lower-case A-Z; most words have no capital and skip the slow path."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1)


def words_of(text: Column) -> Column:
    return F.transform(F.filter(_split(text), lambda w: w != ""), lambda w: F.translate(w, UPPER, LOWER))


def _shuffled(df: DataFrame) -> DataFrame:
    """Join this table by shuffle. Spark would decide by the bytes of compressed
    files, of which a posting takes three or four, and build it on the driver."""
    return df.hint("merge")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table if its counted size allows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else _shuffled(df)


def phrases_of_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as (phrase_id, length, offset, term), and (phrase_id, item_id)."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("window"))
    listed = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    numbered = materialize(listed.withColumn("phrase_id", F.monotonically_increasing_id()), "decon-phrases")
    phrases = numbered.select("phrase_id", F.size("window").alias("length"), F.posexplode("window").alias("offset", "term"))
    return phrases.withColumn("term_id", F.xxhash64("term")), numbered.select("phrase_id", F.explode("items").alias("item_id"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store postings: term_id, row_id, pos. A row with term_id 0 stands for a
    document: its pos is the number of words, and doc_id, h1 and h2 (its id and
    two hashes of its text) are set there alone."""
    text = F.col(text_col).cast("string")
    words = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), _split(text).alias("words")
    )
    lead = (F.col("words")[0] == "").cast("int")
    tail = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    # posexplode would test the list for being empty first, and so cut the text twice
    listed = F.posexplode_outer(F.array_append("words", F.lit(DOCUMENT_MARK)))
    marked = words.select("row_id", "doc_id", "h1", "h2", lead.alias("lead"), (F.size("words") - lead - tail).alias("n"), listed)
    mark = F.col("col") == DOCUMENT_MARK
    only = [F.when(mark, F.col(c)).alias(c) for c in ("doc_id", "h1", "h2")]
    rows = marked.filter("col <> ''").select(
        F.when(mark, 0).otherwise(F.xxhash64(ascii_lower(F.col("col")))).alias("term_id"), "row_id", F.when(mark, F.col("n")).otherwise(F.col("pos") - F.col("lead")).alias("pos"), *only
    )
    # One number is sorted by radix; rows of a term keep their order of documents.
    return materialize(rows.sortWithinPartitions("term_id"), "postings")


def _frequency(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Document frequencies of the phrases' terms, as far as they occur."""
    asked = phrases.select("term_id").distinct()
    found = index.filter("term_id <> 0").select("term_id").join(_small(asked), "term_id", "left_semi")
    return materialize(found.groupBy("term_id").agg(F.count("*").alias("df")), "decon-frequency")


def exact_matches(index: DataFrame, phrases: DataFrame, rarest: int = RAREST, frequency: DataFrame | None = None) -> DataFrame:
    """Every occurrence of every phrase: phrase_id, row_id, start, length.

    ``phrases`` has phrase_id, length, offset, term_id.
    """
    postings = index.filter("term_id <> 0").select("term_id", "row_id", "pos")
    order = Window.partitionBy("phrase_id").orderBy("df", "offset")
    whole = Window.partitionBy("phrase_id")
    ranked = materialize(
        phrases.join(_small(frequency if frequency is not None else _frequency(index, phrases)), "term_id")
        .withColumn("present", F.count("*").over(whole))
        .filter("present = length")  # a phrase with a term that no text has cannot occur
        .withColumn("rarity", F.row_number().over(order))
        .select("phrase_id", "length", "offset", "term_id", "rarity"),
        "decon-ranked",
    )
    first = _small(ranked.filter(F.col("rarity") <= rarest))
    starts = (
        postings.join(first, "term_id")
        .select("phrase_id", "row_id", (F.col("pos") - F.col("offset")).alias("start"), "length")
        .filter("start >= 0")
        .groupBy("phrase_id", "row_id", "start", "length")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.least(F.lit(rarest), F.col("length")))
        .drop("n")
    )
    starts = materialize(starts, "decon-starts")
    rows = _small(materialize(starts.select("row_id").distinct(), "decon-rows"))
    rest = starts.join(_small(ranked.filter(F.col("rarity") > rarest).select("phrase_id", "offset", "term_id")), "phrase_id").withColumn(
        "pos", F.col("start") + F.col("offset")
    )
    near = postings.join(rows, "row_id", "left_semi").select("row_id", "term_id", "pos")
    checked = (
        rest.join(_shuffled(near), ["row_id", "pos", "term_id"])
        .groupBy("phrase_id", "row_id", "start", "length")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("length") - rarest)
        .drop("n")
    )
    return checked.unionByName(starts.filter(F.col("length") <= rarest))


def proximity_matches(index: DataFrame, phrases: DataFrame, span: int = NEAR_SPAN, frequency: DataFrame | None = None) -> DataFrame:
    """(phrase_id, row_id, anchor) where all the phrase's distinct terms stand
    less than ``span`` words from the anchor, a posting of its rarest term (of
    equally rare ones the first as a string).

    Lists meet by equi-joins on (row, block of ``span`` positions), each posting
    listed in its own block and the neighbouring ones.
    """
    postings = index.filter("term_id <> 0").select("term_id", "row_id", "pos")
    whole = Window.partitionBy("phrase_id")
    terms = phrases.select("phrase_id", "term", "term_id").distinct().withColumn("n_terms", F.count("*").over(whole))
    ranked = terms.join(_small(frequency if frequency is not None else _frequency(index, phrases)), "term_id").withColumn("present", F.count("*").over(whole)).filter("present = n_terms")
    ranked = materialize(ranked.withColumn("rarity", F.row_number().over(whole.orderBy("df", "term"))).select("phrase_id", "term_id", "n_terms", "rarity"), "decon-near")
    rare = materialize(postings.join(_small(ranked.filter("rarity <= 2")), "term_id"), "decon-rare")
    spread = F.explode(F.expr(f"array(pos div {span} - 1, pos div {span}, pos div {span} + 1)")).alias("block")
    close = F.abs(F.col("pos") - F.col("anchor")) < span
    anchors = rare.filter("rarity = 1").select("phrase_id", "row_id", F.col("pos").alias("anchor"), "n_terms", F.expr(f"pos div {span}").alias("block"))
    second = rare.filter("rarity = 2").select("phrase_id", "row_id", "pos", spread)
    met = anchors.filter("n_terms > 1").join(_shuffled(second), ["phrase_id", "row_id", "block"]).filter(close).select("phrase_id", "row_id", "anchor", "n_terms", "block").distinct()
    met = materialize(met.unionByName(anchors.filter("n_terms = 1")), "decon-anchors")
    rest = met.join(_small(ranked.filter("rarity > 2").select("phrase_id", "term_id")), "phrase_id")
    rows = _small(materialize(rest.select("row_id").distinct(), "decon-rows"))
    wanted = _small(ranked.filter("rarity > 2").select("term_id").distinct())
    lists = postings.join(rows, "row_id", "left_semi").join(wanted, "term_id", "left_semi").select("row_id", "term_id", "pos", spread)
    full = (
        rest.join(_shuffled(lists), ["row_id", "term_id", "block"])
        .filter(close)
        .groupBy("phrase_id", "row_id", "anchor", "n_terms")
        .agg(F.count_distinct("term_id").alias("n"))
        .filter("n = n_terms - 2")
    )
    return full.select("phrase_id", "row_id", "anchor").unionByName(met.filter("n_terms <= 2").select("phrase_id", "row_id", "anchor"))


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, near: bool) -> DataFrame:
    phrases, items = phrases_of_items(benchmark)
    index = build_index(docs, id_col, text_col)
    frequency = _frequency(index, phrases)
    found = materialize(exact_matches(index, phrases, frequency=frequency), "decon-found")
    before = Window.partitionBy("row_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        found.groupBy("row_id", "start")
        .agg(F.max("length").alias("length"))
        .withColumn("end", F.col("start") + F.col("length"))
        .withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("row_id")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))).alias("n_hit"))
    )
    named = lambda matches: matches.select("row_id", "phrase_id").distinct().join(_small(items), "phrase_id").groupBy("row_id")
    exact = named(found).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = index.filter("term_id = 0").select("row_id", "doc_id", "h1", "h2", F.col("pos").cast("long").alias("n_words")).join(_shuffled(hit.join(_shuffled(exact), "row_id")), "row_id", "left")
    columns = [
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
    ]
    verdict = ((F.col("n_hit") > 0) & (CONTAMINATED_ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    if not near:
        return rows.select(*columns, "h1", "h2").select("*", verdict)
    close = named(proximity_matches(index, phrases, frequency=frequency)).agg(F.count_distinct("item_id").alias("n_near_items"))
    rows = rows.join(_shuffled(close), "row_id", "left")
    return rows.select(*columns, F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")).select("*", verdict)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row,
    and n_near_items, the items of which a window's terms all stand near one
    another (see ``proximity_matches``)."""
    return concluded(docs.sparkSession, "decon-judged", lambda: _judged(docs, benchmark, id_col, text_col, near=True))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept. Rows are
    told by two hashes of their text, as equal texts are judged alike."""
    dirty = lambda: _judged(docs, benchmark, id_col, text_col, near=False).filter("contaminated").select("h1", "h2").distinct()
    found = concluded(docs.sparkSession, "decon-dirty", dirty)
    text = docs[text_col].cast("string")
    return docs.join(_small(found), (F.xxhash64(text) == found["h1"]) & (F.xxhash64(F.lit("second"), text) == found["h2"]), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[s:s + 12], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS s FROM b WHERE len(words) > 0)
), g AS (
  SELECT doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w))
), o AS (
  SELECT doc_id, s, g.n, item_id FROM g JOIN w USING (gram) WHERE g.n = w.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM o) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id
), tok AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM d
), df AS (SELECT word, count(*) AS df FROM tok GROUP BY word),
wt AS (
  SELECT gram, word, n_terms, row_number() OVER (PARTITION BY gram ORDER BY df, word) AS rarity, count(df) OVER (PARTITION BY gram) AS present
  FROM (SELECT gram, word, count(*) OVER (PARTITION BY gram) AS n_terms FROM (SELECT DISTINCT gram, unnest(string_split(gram, ' ')) AS word FROM w)) LEFT JOIN df USING (word)
), anchor AS (
  SELECT gram, doc_id, pos AS anchor, n_terms FROM tok JOIN wt USING (word) WHERE rarity = 1 AND present = n_terms
), near AS (
  SELECT gram, doc_id, anchor FROM anchor WHERE n_terms = 1
  UNION ALL
  SELECT gram, doc_id, anchor FROM anchor JOIN (SELECT gram, word FROM wt WHERE rarity > 1) USING (gram) JOIN tok USING (doc_id, word)
  WHERE abs(pos - anchor) < 26 GROUP BY gram, doc_id, anchor, n_terms HAVING count(DISTINCT word) = n_terms - 1
), k AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN w USING (gram) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_near_items, 0)::BIGINT AS n_near_items,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN k USING (doc_id)
"""
