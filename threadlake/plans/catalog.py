"""Named queries over the driver's tables, with their SQL twins.

Each query applies one operator to a whole table. Where the reference leaves
ties to chance, orders here end with a unique key, in both forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import order
from threadlake.functions import text as T
from threadlake.operators import calls, find, index, notes, profile, said, scrub, search, selectors, sessions, stored_index, windows
from threadlake.plans import adapters as A
from threadlake.session import shared_root

TERM, TERMS, SHORT = "tion", ["the", "tion", "and the"], ["er", "tion", "xq"]
SINCE = "2024-01-15"
DESCRIPTION = "the session where we talked about retion and the threnes"
BENCH_QUERY = "the and"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


ALC = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _occ(text: str, term: str) -> str:
    low = ALC.format(text)
    return f"greatest(1, (length({low}) - length(replace({low}, '{term}', ''))) // {len(term)})"


def _occ_full(text: str, term: str) -> str:
    return f"((length(lower({text})) - length(replace(lower({text}), '{term}', ''))) // {len(term)})"


VISIBLE = "role IN ('user', 'assistant')"


@query(f"""
SELECT conv_id AS path, sum({_occ('text', TERM)})::BIGINT AS count FROM conversations
WHERE {VISIBLE} AND contains(lower(text), '{TERM}') GROUP BY conv_id ORDER BY count DESC, path LIMIT 10
""")
def search_rank(spark, sf_dir):
    return search.rank(search.visible(A.messages(spark, sf_dir)), TERM)


@query(f"""
WITH r AS (
  SELECT conv_id, sum({_occ('text', TERM)}) AS n FROM conversations WHERE {VISIBLE} AND contains(lower(text), '{TERM}')
  GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 10
), m AS (
  SELECT conv_id, turn, role, text, instr(lower(text), '{TERM}') - 1 AS spot, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations WHERE {VISIBLE} AND contains(lower(text), '{TERM}') AND conv_id IN (SELECT conv_id FROM r)
)
SELECT conv_id AS path, n::INT AS n, turn AS seq, role,
  CASE WHEN spot > 100 THEN '...' ELSE '' END || substr(text, greatest(0, spot - 100) + 1, least(length(text), spot + {len(TERM)} + 100) - greatest(0, spot - 100))
  || CASE WHEN spot + {len(TERM)} + 100 < length(text) THEN '...' ELSE '' END AS snippet
FROM m WHERE n <= 3
""")
def search_snippets(spark, sf_dir):
    rows = search.visible(A.messages(spark, sf_dir))
    return search.snippets(rows, search.rank(rows, TERM), TERM)


@query(f"""
SELECT user_id AS path, sum({_occ('props', '"k": 1')})::BIGINT AS count, min(strftime(ts, '%Y-%m-%d')) AS date FROM events
WHERE contains(lower(props), '"k": 1') AND strftime(ts, '%Y-%m-%d') >= '{SINCE}' GROUP BY user_id ORDER BY count DESC, date DESC, path LIMIT 10
""")
def search_since(spark, sf_dir):
    return search.rank(A.dated_messages(spark, sf_dir), '"k": 1', since=SINCE)


@query("""
SELECT doc_id AS path, len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the')))::BIGINT AS count
FROM documents WHERE contains(lower(text), 'the')
""")
def search_raw_lines(spark, sf_dir):
    return search.matching_lines(A.notes(spark, sf_dir), "the")


@query("""
SELECT user_id AS path, event_type AS tool, count(*) AS count FROM events
WHERE event_type NOT IN ('purchase', 'error') AND contains(lower(props), '"k": 7') GROUP BY ALL
""")
def search_tools(spark, sf_dir):
    calls = A.tool_events(spark, sf_dir).filter("kind = 'tool_call'")
    return calls.filter(T.has(F.col("input"), '"k": 7')).groupBy("path", "tool").agg(F.count("*").alias("count"))


@query("""
SELECT user_id AS path, max(strftime(ts, '%Y-%m-%d')) AS date, max(epoch_us(ts) // 1000) AS time_ms, count(*) OVER () AS total FROM events
GROUP BY user_id HAVING max(strftime(ts, '%Y-%m-%d')) >= '2024-01-15' ORDER BY date DESC, time_ms DESC, path LIMIT 10
""")
def last_recent(spark, sf_dir):
    return search.recent_sessions(A.dated_messages(spark, sf_dir), SINCE)


@query("""
SELECT conv_id AS path, turn AS seq, text FROM conversations
WHERE role = 'assistant' AND contains(lower(text), 'the') AND contains(lower(text), 'tion') ORDER BY turn DESC, conv_id LIMIT 20
""")
def rows_with_words(spark, sf_dir):
    return search.rows_with_words(A.messages(spark, sf_dir), ["the", "of", "tion"], 20).select("path", "seq", "text")


_PREFIX_SQL = " OR ".join(f"starts_with(trim(text), '{p}')" for p in T.INJECTED_PREFIXES)
_TERM_ROWS = f"""
m AS (SELECT * FROM conversations WHERE {VISIBLE} AND (role <> 'user' OR (trim(text) <> '' AND NOT ({_PREFIX_SQL})))),
s AS (
  SELECT conv_id AS path, term, count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role = 'assistant') AS assistant_count
  FROM m, (SELECT unnest([{{terms}}]) AS term) WHERE contains(lower(text), lower(term)) GROUP BY ALL
)"""


def _terms(terms) -> str:
    return _TERM_ROWS.format(terms=", ".join(f"'{t}'" for t in terms))


@query(f"WITH {_terms(TERMS)} SELECT *, 5 * user_count + assistant_count AS score FROM s")
def find_scores(spark, sf_dir):
    return find.term_scores(A.messages(spark, sf_dir), TERMS)


_CANDIDATES = """
c AS (
  SELECT path, count(*) AS n_terms, min({n}) AS min_count, sum({n})::BIGINT AS total, sum({score})::BIGINT AS score, list(term) AS matched
  FROM s WHERE {n} > 0 GROUP BY path
), k AS (SELECT *, count(*) OVER () > 40 AS truncated FROM c ORDER BY n_terms DESC, min_count DESC, total DESC, path LIMIT 40)"""
_BOTH, _USER = {"n": "(user_count + assistant_count)", "score": "5 * user_count + assistant_count"}, {"n": "user_count", "score": "5 * user_count"}


@query(f"WITH {_terms(TERMS)}, {_CANDIDATES.format(**_BOTH)} SELECT path, n_terms, min_count, total, score, truncated FROM k")
def find_candidates(spark, sf_dir):
    return find.candidates(A.messages(spark, sf_dir), TERMS).drop("matched")


def _relaxed_sql(kind: dict, limit: int = 5) -> str:
    return f"""
WITH {_terms(TERMS)}, {_CANDIDATES.format(**kind)},
t AS (SELECT matched AS required FROM k ORDER BY n_terms DESC, score DESC, path LIMIT 1)
SELECT path, score FROM k, t WHERE len(list_intersect(matched, required)) = len(required) ORDER BY n_terms DESC, score DESC, path LIMIT {limit}"""


@query(_relaxed_sql(_BOTH))
def find_relaxed(spark, sf_dir):
    return find.relaxed(A.messages(spark, sf_dir), TERMS).select("path", "score")


_DATED = "strftime(DATE '2024-01-01' + (path % 7)::INT, '%Y-%m-%d')"


def _dated(spark, sf_dir):
    """Conversations with a date each, many of them equal."""
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("path") % 7).cast("int")), "yyyy-MM-dd")
    return A.messages(spark, sf_dir).withColumn("date", date)


@query(_relaxed_sql(_BOTH, 40).replace("ORDER BY n_terms DESC, score DESC, path", f"ORDER BY n_terms DESC, score DESC, {_DATED} DESC, path"))
def find_newest_of_equals(spark, sf_dir):
    return find.relaxed(_dated(spark, sf_dir), TERMS, limit=40).select("path", "score")


@query(f"""
WITH {_terms(find.keywords(DESCRIPTION))}
SELECT path, count(*) AS n_keywords, sum(5 * user_count + assistant_count)::BIGINT AS score FROM s GROUP BY path ORDER BY n_keywords DESC, score DESC, {_DATED} DESC, path LIMIT 30
""")
def recall_newest_of_equals(spark, sf_dir):
    return find.recall(_dated(spark, sf_dir), DESCRIPTION)


@query(_relaxed_sql(_USER))
def find_user_only(spark, sf_dir):
    return find.relaxed(A.messages(spark, sf_dir), TERMS, user_only=True).select("path", "score")


@query("""
SELECT source AS project, count(*) AS hits FROM documents WHERE contains(lower(source), 'src1') AND contains(lower(text), 'the') GROUP BY source
""")
def find_project(spark, sf_dir):
    kept = A.notes(spark, sf_dir).filter(T.project_matches(F.col("project"), "SRC1")).filter(T.has(F.col("text"), "the"))
    return kept.groupBy("project").agg(F.count("*").alias("hits"))


@query(f"""
WITH {_terms(SHORT)} SELECT *, 5 * user_count + assistant_count AS score FROM s WHERE path IN (SELECT path FROM s WHERE length(term) >= 3)
""")
def find_mixed_short(spark, sf_dir):
    return find.within_long_terms(A.messages(spark, sf_dir), SHORT)


@query(f"""
WITH p AS (SELECT conv_id AS path, arg_min(trim(text), turn) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT ({_PREFIX_SQL}) GROUP BY conv_id)
SELECT path, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 299) || '…' END AS opening FROM p
""")
def find_opening_prompt(spark, sf_dir):
    return find.opening_prompts(A.messages(spark, sf_dir))


@query("SELECT user_id AS path, max(strftime(ts, '%Y-%m-%d')) AS date FROM events GROUP BY user_id")
def session_activity(spark, sf_dir):
    return find.activity(A.dated_messages(spark, sf_dir))


@query(f"""
WITH {_terms(find.keywords(DESCRIPTION))}
SELECT path, count(*) AS n_keywords, sum(5 * user_count + assistant_count)::BIGINT AS score FROM s GROUP BY path ORDER BY n_keywords DESC, score DESC, path LIMIT 30
""")
def recall_candidates(spark, sf_dir):
    return find.recall(A.messages(spark, sf_dir), DESCRIPTION)


_HITS = " + ".join(f"least({_occ_full('text', t)}, 8)" for t in TERMS)


@query(f"""
WITH m AS (
  SELECT conv_id, turn, ({_HITS}) * CASE WHEN role = 'user' THEN 2 ELSE 1 END AS hits, greatest(length(text), 200) AS size
  FROM conversations WHERE {VISIBLE} AND (role <> 'user' OR (trim(text) <> '' AND NOT ({_PREFIX_SQL})))
), w AS (
  SELECT *, sum(hits) OVER n AS matches, sum(size) OVER n AS chars FROM m
  WINDOW n AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
)
SELECT conv_id AS path, turn AS anchor, matches::BIGINT AS matches, chars::BIGINT AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY matches::DOUBLE / chars DESC, turn) AS rank FROM w WHERE hits > 0
""")
def pack_density(spark, sf_dir):
    return windows.densities(A.messages(spark, sf_dir), TERMS)


def _clip_sql(text: str, cap: str, terms: list[str]) -> tuple[str, str]:
    """Body and start of ``T.clipped`` for texts without characters of two units."""
    spots = ", ".join(f"CASE WHEN contains(lower({text}), '{t}') THEN {{'at': instr(lower({text}), '{t}') - 1, 'size': {len(t)}}} END" for t in terms)
    spot = f"list_min(list_filter([{spots}], lambda s: s IS NOT NULL))"
    begin = f"least(greatest(0, {spot}.at - (greatest(0, {cap} - 2 - {spot}.size) // 2)), length({text}) - ({cap} - 1))"
    room = f"({cap} - CASE WHEN {begin} > 0 THEN 1 ELSE 0 END)"
    trail = f"length({text}) - {begin} > {room}"
    around = f"CASE WHEN {begin} > 0 THEN '…' ELSE '' END || substr({text}, {begin} + 1, {room} - CASE WHEN {trail} THEN 1 ELSE 0 END) || CASE WHEN {trail} THEN '…' ELSE '' END"

    def cases(whole: str, bare: str, tiny: str, cut: str) -> str:
        return f"CASE WHEN length({text}) <= {cap} THEN {whole} WHEN {spot} IS NULL THEN {bare} WHEN {cap} < 3 THEN {tiny} ELSE {cut} END"

    body = cases(text, f"substr({text}, 1, greatest(0, {cap} - 1)) || '…'", f"CASE WHEN {cap} > 0 THEN '…' ELSE '' END", around)
    return body, cases("0", "0", "0", begin)


_PACK_BODY, _ = _clip_sql("c.text", "each_", [t.lower() for t in TERMS])


@query(f"""
WITH d AS ({ORACLE_SQL["pack_density"]}), best AS ({_relaxed_sql(_BOTH, 3)}),
m AS (
  SELECT conv_id AS path, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
  FROM conversations WHERE {VISIBLE} AND (role <> 'user' OR (trim(text) <> '' AND NOT ({_PREFIX_SQL}))) AND conv_id IN (SELECT path FROM best)
), l AS (
  SELECT m.path, m.seq, row_number() OVER (PARTITION BY m.path ORDER BY d.rank, m.seq <> d.anchor, o.rank IS NULL, abs(m.seq - d.anchor), m.seq) AS listed
  FROM d JOIN m a ON d.path = a.path AND d.anchor = a.seq JOIN m ON m.path = a.path AND m.pos BETWEEN a.pos - 2 AND a.pos + 2 LEFT JOIN d o ON o.path = m.path AND o.anchor = m.seq
), f AS (SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY min(listed)) AS place FROM l GROUP BY path, seq),
k AS (SELECT path, seq, least(1200, 4000 // count(*) OVER (PARTITION BY path)) AS each_ FROM f WHERE place <= 10)
SELECT k.path, k.seq::BIGINT AS idx, {_PACK_BODY} AS body, length(c.text)::BIGINT AS original_chars FROM k JOIN conversations c ON c.conv_id = k.path AND c.turn = k.seq
""")
def pack_budget(spark, sf_dir):
    return windows.pack(A.messages(spark, sf_dir), TERMS)


@query("""
WITH l AS (
  SELECT item_id, i, list_filter(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS line
  FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark)
), k AS (SELECT item_id, line, row_number() OVER (PARTITION BY item_id ORDER BY len(line) DESC, min(i)) AS n FROM l WHERE len(line) >= 3 GROUP BY item_id, line),
p AS (SELECT item_id AS probe, array_to_string(line, ' ') AS run, least(2, count(*) OVER (PARTITION BY item_id)) AS needed FROM k WHERE n <= 8),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS w FROM documents)
SELECT probe, doc_id AS path, count(*) AS lines FROM p JOIN d ON contains(d.w, ' ' || p.run || ' ') GROUP BY probe, doc_id, needed HAVING count(*) >= needed
""")
def last_said(spark, sf_dir):
    probes = said.probes(A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe"), "text"))
    return said.wrote(A.notes(spark, sf_dir), probes)


@query(f"""
WITH m AS (
  SELECT conv_id, turn, row_number() OVER w AS rn, sum(least(octet_length(encode(text)) * 0 + length(text), 1500)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used
  FROM conversations WHERE {VISIBLE} WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)
)
SELECT conv_id AS path, min(turn) AS tail_start, count(*) AS kept, max(used)::BIGINT AS used FROM m WHERE rn = 1 OR (rn <= 12 AND used <= 2000) GROUP BY conv_id
""")
def last_tail(spark, sf_dir):
    return windows.tail(A.messages(spark, sf_dir), budget=2000)


@query(f"""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE {VISIBLE}),
a AS (SELECT conv_id, pos FROM m WHERE contains(lower(text), 'ierle')),
k AS (SELECT DISTINCT m.* FROM m JOIN a ON m.conv_id = a.conv_id AND m.pos BETWEEN a.pos - 1 AND a.pos + 1)
SELECT conv_id AS path, turn AS seq, pos, role, text, pos - lag(pos, 1, -1) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS gap_before FROM k
""")
def show_around(spark, sf_dir):
    rows = A.messages(spark, sf_dir)
    anchors = search.visible(rows).filter(T.has(F.col("text"), "ierle"))
    return windows.around(rows, anchors, context=1)


@query("SELECT user_id AS path, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events")
def events_numbered(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").withColumnRenamed("user_id", "path")
    return windows.numbered(rows, "ts", "event_id").select("path", "event_id", "idx")


@query("SELECT user_id AS path, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS tool_calls, count(*) FILTER (event_type IN ('purchase', 'error')) AS tool_results FROM events GROUP BY user_id")
def events_counts(spark, sf_dir):
    return A.tool_events(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("kind") == "tool_call").alias("tool_calls"), F.count_if(F.col("kind") == "tool_result").alias("tool_results"))


_PAGE_BODY, _PAGE_START = _clip_sql("e.text", "least(120, 300 - r.used)", [TERM.lower()])


@query(f"""
WITH RECURSIVE e AS (
  SELECT conv_id AS path, turn AS idx, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn >= 1
), r AS (
  SELECT DISTINCT path, 0::BIGINT AS n, 0::BIGINT AS idx, '' AS body, 0::BIGINT AS start_char, 0::BIGINT AS original_chars, false AS clipped, 0::BIGINT AS used FROM e
  UNION ALL
  SELECT path, n, idx, body, start_char, original_chars, clipped, used + length(body) FROM (
    SELECT e.path, e.n, e.idx, {_PAGE_BODY} AS body, {_PAGE_START} AS start_char, length(e.text) AS original_chars, length(e.text) > least(120, 300 - r.used) AS clipped, r.used
    FROM r JOIN e ON e.path = r.path AND e.n = r.n + 1 WHERE r.n < 4 AND r.used < 300)
), x AS (SELECT path, max(n) AS last FROM r GROUP BY path)
SELECT r.path, r.idx, r.body, r.original_chars, r.start_char, r.clipped, e.idx AS next_event
FROM r JOIN x USING (path) LEFT JOIN e ON e.path = x.path AND e.n = x.last + 1 WHERE r.n > 0
""")
def events_page(spark, sf_dir):
    return windows.pages(A.messages(spark, sf_dir).withColumnRenamed("seq", "idx"), start=1, limit=4, cap=120, budget=300, focus=[TERM])


@query(f"SELECT conv_id AS path, turn AS seq FROM conversations WHERE {VISIBLE} QUALIFY count(*) OVER (PARTITION BY conv_id) <= 8")
def query_window(spark, sf_dir):
    """Conversations of the tables have eight messages at most, which are shown
    whole; windows of longer ones are tested against a plain version."""
    return windows.question_window(A.messages(spark, sf_dir), ["the", "tion"], 375)


_EVENTS = """
e AS (
  SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS tool, props AS call_id,
    event_type IN ('purchase', 'error') AS result, event_type = 'error' AS is_error, (epoch_us(ts) // 1000) AS ms, value AS size FROM events
), p AS (
  SELECT r.path, r.idx, r.size, r.is_error, r.ms, max(c.idx) AS call_idx FROM e r JOIN e c ON r.path = c.path AND r.call_id = c.call_id AND c.idx < r.idx AND NOT c.result
  WHERE r.result GROUP BY ALL
), q AS (SELECT p.*, c.tool AS call_tool, c.ms AS call_ms, row_number() OVER (PARTITION BY p.path, call_idx ORDER BY p.idx) AS nth FROM p JOIN e c ON p.path = c.path AND p.call_idx = c.idx),
f AS (SELECT path, idx, tool, first_value(idx) OVER (PARTITION BY path, tool, call_id ORDER BY idx) AS repeat_of FROM e WHERE NOT result)"""


@query(f"WITH {_EVENTS} SELECT path, idx, call_idx, call_tool, nth FROM q")
def profile_pairs(spark, sf_dir):
    return profile.paired(A.tool_events(spark, sf_dir)).select("path", "idx", "call_idx", "call_tool", "nth")


@query(f"WITH {_EVENTS} SELECT path, call_idx, ms - call_ms AS latency_ms FROM q WHERE nth = 1 AND ms >= call_ms")
def profile_latency(spark, sf_dir):
    return profile.latencies(A.tool_events(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT path, idx, tool, repeat_of FROM f WHERE repeat_of < idx")
def profile_repeats(spark, sf_dir):
    return profile.repeats(A.tool_events(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT path, tool, repeat_of AS first_idx, count(*) AS calls FROM f GROUP BY ALL HAVING count(*) > 1")
def profile_repeat_groups(spark, sf_dir):
    return profile.repeat_groups(A.tool_events(spark, sf_dir))


@query(f"""
WITH {_EVENTS}, c AS (SELECT path, tool, count(*) AS calls FROM e WHERE NOT result GROUP BY ALL),
o AS (SELECT path, call_tool AS tool, round(sum(size), 4) AS output, count(*) FILTER (is_error) AS errors FROM q GROUP BY ALL)
SELECT path, tool, calls, coalesce(output, 0.0) AS output, coalesce(errors, 0) AS errors FROM c LEFT JOIN o USING (path, tool)
""")
def profile_tools(spark, sf_dir):
    return profile.per_tool(A.tool_events(spark, sf_dir))


@query(f"""
WITH {_EVENTS}, b AS (
  SELECT path, count(*) FILTER (NOT result) AS tool_calls, count(*) FILTER (result) AS tool_results, count(*) FILTER (result AND size > 50) AS oversized_results,
    count(*) FILTER (result AND is_error) AS error_results FROM e GROUP BY path
), m AS (SELECT path, count(*) AS n, count(DISTINCT call_idx) AS a FROM q GROUP BY path), r AS (SELECT path, count(*) AS n FROM f WHERE repeat_of < idx GROUP BY path)
SELECT path, tool_calls, tool_results, oversized_results, error_results, coalesce(r.n, 0) AS repeated_calls, tool_results - coalesce(m.n, 0) AS unmatched_results,
  tool_calls - coalesce(m.a, 0) AS calls_without_results FROM b LEFT JOIN m USING (path) LEFT JOIN r USING (path)
""")
def profile_metrics(spark, sf_dir):
    return profile.metrics(A.tool_events(spark, sf_dir), threshold=50)


@query(f"""
WITH {_EVENTS}, o AS (SELECT path, call_idx AS idx, round(sum(size), 4) AS output, bool_or(is_error) AS failed FROM q GROUP BY ALL),
c AS (
  SELECT f.path, f.idx, f.tool, coalesce(o.output, 0.0) AS output FROM f LEFT JOIN o USING (path, idx) WHERE coalesce(failed, false) OR repeat_of < f.idx
), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY output DESC, idx) AS rank FROM c)
SELECT path, idx AS call_idx, tool, output, rank FROM r WHERE rank <= 12 ORDER BY output DESC, path, idx LIMIT 40
""")
def profile_evidence(spark, sf_dir):
    return profile.evidence(A.tool_events(spark, sf_dir))


@query("""
WITH s AS (
  SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
    CASE event_type WHEN 'signup' THEN 'reply' WHEN 'error' THEN 'result' ELSE 'call' END AS kind FROM events
), b AS (SELECT *, sum((kind = 'reply')::INT) OVER (PARTITION BY path ORDER BY line) AS block FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY path, block, kind ORDER BY line) AS nth FROM b)
SELECT r.path, r.line AS result_line, c.line AS call_line FROM n r LEFT JOIN n c ON r.path = c.path AND r.block = c.block AND r.nth = c.nth AND c.kind = 'call' WHERE r.kind = 'result'
""")
def profile_fifo(spark, sf_dir):
    from pyspark.sql import Window

    steps = A.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line"),
        F.when(F.col("event_type") == "signup", "reply").when(F.col("event_type") == "error", "result").otherwise("call").alias("kind"),
    )
    return profile.fifo_pairs(steps)


@query("SELECT source AS project, count(*) AS files FROM documents GROUP BY source")
def memory_list(spark, sf_dir):
    return notes.projects(A.notes(spark, sf_dir))


_KEYWORD_SQL = f"""
s AS (
  SELECT doc_id AS path, source AS project, ({_occ_full('text', 'the')} + {_occ_full('text', 'and')})::BIGINT AS count,
    (least({_occ_full('text', 'the')}, 5) + least({_occ_full('text', 'and')}, 5) + CASE WHEN contains(lower(text), 'the and') THEN 5 ELSE 0 END)::BIGINT AS score
  FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')
), kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, count DESC, path) AS rank FROM s QUALIFY rank <= 20)"""


@query(f"WITH {_KEYWORD_SQL} SELECT path, project, count, score, rank FROM kw")
def memory_keyword(spark, sf_dir):
    return notes.keyword(A.notes(spark, sf_dir), BENCH_QUERY)


@query("""
SELECT doc_id AS path, source AS project FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(source), 'src1') AND lang = 'fr' ORDER BY
  least((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4, 5) DESC, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 DESC, doc_id LIMIT 20
""")
def memory_filtered(spark, sf_dir):
    return notes.keyword(A.notes(spark, sf_dir), "tion", project="src1", kind="FR").select("path", "project")


@query("""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
  WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')
), h AS (SELECT *, contains(lower(line), 'the')::INT + contains(lower(line), 'and')::INT AS hits FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, k) AS n FROM h WHERE hits > 0)
SELECT doc_id AS path, (n - 1)::INT AS n, line FROM r WHERE n <= 3
""")
def memory_snippets(spark, sf_dir):
    return notes.line_snippets(A.notes(spark, sf_dir), BENCH_QUERY)


def _query_vec(chunks):
    """The first chunk's vector stands in for an embedded question."""
    return chunks.filter("id = 0").first()["vec"]


_NEAREST_SQL = """
v AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS sim FROM embeddings),
b AS (SELECT label AS path, vec_id AS id, sim FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) = 1),
nr AS (SELECT *, row_number() OVER (ORDER BY sim DESC, path) AS rank FROM b WHERE sim >= greatest({floor}, (SELECT max(sim) FROM b) - {margin}) QUALIFY rank <= 20)"""


@query(f"WITH {_NEAREST_SQL.format(floor=-1.0, margin=0.9)} SELECT path::INT AS path, id, sim, rank FROM nr")
def memory_nearest(spark, sf_dir):
    chunks = A.chunks(spark, sf_dir)
    return notes.nearest(chunks, _query_vec(chunks), floor=-1.0, margin=0.9)


@query(f"WITH {_NEAREST_SQL.format(floor=0.65, margin=0.06)} SELECT path::INT AS path, id, sim, rank FROM nr")
def memory_nearest_floor(spark, sf_dir):
    chunks = A.chunks(spark, sf_dir)
    return notes.nearest(chunks, _query_vec(chunks))


@query(f"""
WITH {_KEYWORD_SQL}, {_NEAREST_SQL.format(floor=-1.0, margin=2.0)},
u AS (SELECT coalesce(kw.path, nr.path) AS path, kw.rank AS kr, nr.rank AS vr FROM kw FULL JOIN nr ON kw.path = nr.path)
SELECT path, round(coalesce(1 / (60 + kr), 0.0) + coalesce(1 / (60 + vr), 0.0), 9) AS score,
  CASE WHEN kr IS NULL THEN 'semantic' WHEN vr IS NULL THEN 'keyword' ELSE 'both' END AS match
FROM u ORDER BY score DESC, match = 'semantic', path LIMIT 20
""")
def memory_hybrid(spark, sf_dir):
    chunks = A.chunks(spark, sf_dir)
    vectors = notes.nearest(chunks, _query_vec(chunks), floor=-1.0, margin=2.0).withColumn("path", F.col("path").cast("long"))
    return notes.fuse(notes.keyword(A.notes(spark, sf_dir), BENCH_QUERY), vectors)


@query("""
WITH n AS (SELECT source AS path, sha256(lang || chr(10) || text) AS sha, doc_id % 10 AS part FROM documents),
k AS (SELECT path, sha FROM n WHERE part <> 3 GROUP BY ALL), w AS (SELECT path, sha FROM n WHERE part <> 7 GROUP BY ALL)
SELECT coalesce(k.path, w.path) AS path, coalesce(k.sha, w.sha) AS sha, CASE WHEN k.sha IS NULL THEN 'add' WHEN w.sha IS NULL THEN 'delete' ELSE 'keep' END AS action
FROM k FULL JOIN w ON k.path = w.path AND k.sha = w.sha
""")
def chunk_sha_diff(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), notes.content_sha(F.col("lang"), F.col("text")).alias("sha"), (F.col("doc_id") % 10).alias("part"))
    return notes.chunk_diff(rows.filter("part <> 3"), rows.filter("part <> 7"))  # before and after an edit


_STATUS = "CASE vec_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'submitted' WHEN 2 THEN 'retry' WHEN 3 THEN 'done' WHEN 4 THEN 'failed' ELSE 'withheld' END"


def _queue(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr(_STATUS).alias("status"), F.expr("vec_id div 50").alias("batch_id"), F.expr("concat('m', vec_id % 2)").alias("model"), F.lit(64).alias("dims"), F.col("embedding").alias("vec"))


@query(f"""
WITH q AS (SELECT vec_id, {_STATUS} AS status, vec_id // 50 AS batch_id FROM embeddings)
SELECT {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('pending', 'submitted', 'retry', 'done', 'failed', 'withheld'))},
  count(DISTINCT batch_id) FILTER (status = 'submitted') AS batches FROM q
""")
def queue_status(spark, sf_dir):
    return notes.queue_counts(_queue(spark, sf_dir))


@query(f"""
SELECT vec_id AS id, CASE WHEN {_STATUS} <> 'withheld' AND vec_id % 2 <> 1 THEN 'pending' ELSE {_STATUS} END AS status,
  NOT ({_STATUS} <> 'withheld' AND vec_id % 2 <> 1) AS has_vec FROM embeddings
""")
def queue_invalidate(spark, sf_dir):
    return notes.invalidate(_queue(spark, sf_dir), "m1", 64).select("id", "status", F.col("vec").isNotNull().alias("has_vec"))


@query(f"SELECT vec_id AS id, CASE {_STATUS} WHEN 'failed' THEN 'pending' ELSE {_STATUS} END AS status FROM embeddings")
def queue_requeue(spark, sf_dir):
    return notes.requeue_failed(_queue(spark, sf_dir)).select("id", "status")


@query(f"""
SELECT vec_id AS id, CASE WHEN {_STATUS} = 'submitted' AND vec_id % 4 = 1 THEN 'done' ELSE {_STATUS} END AS status FROM embeddings
""")
def queue_store(spark, sf_dir):
    queue = _queue(spark, sf_dir).withColumn("sha", F.sha2(F.col("id").cast("string"), 256))
    results = queue.withColumn("sha", F.when(F.col("id") % 4 == 1, F.col("sha")).otherwise("stale"))  # half come back for other content
    return notes.store_vectors(queue, results).select("id", "status")


_SECRET_SQL = " OR ".join(f"(length(t) >= {n} AND starts_with(t, '{p}'))" for p, n in T.SECRET_PREFIXES)


_SHAPED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) WHEN 2 THEN text || ' ghp_' || md5(doc_id::VARCHAR) ELSE text || ' sk-' || substr(md5(doc_id::VARCHAR), 1, 20) END"


@query(f"""
SELECT path FROM (SELECT doc_id AS path, {_SHAPED} AS text FROM documents)
WHERE (contains(text, '-----BEGIN') AND contains(text, 'PRIVATE KEY'))
  OR len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_-]+'), lambda t: {_SECRET_SQL})) > 0
""")
def secret_filter(spark, sf_dir):
    """Credentials of two shapes, and one too short, are written behind most texts."""
    digest = F.md5(F.col("path").cast("string").cast("binary"))
    text = F.col("text")
    shaped = (
        F.when(F.col("path") % 4 == 1, F.concat(text, F.lit(" AKIA"), F.upper(F.substring(digest, 1, 16))))
        .when(F.col("path") % 4 == 2, F.concat(text, F.lit(" ghp_"), digest))
        .when(F.col("path") % 4 == 3, F.concat(text, F.lit(" sk-"), F.substring(digest, 1, 20)))
        .otherwise(text)
    )
    return A.notes(spark, sf_dir).withColumn("text", shaped).filter(T.looks_secret(F.col("text"))).select("path")


@query("""
SELECT doc_id AS path, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]{3}')))::BIGINT AS lines FROM documents
WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]{3}'))) > 0
""")
def scrub_patterns(spark, sf_dir):
    return scrub.pattern_lines(A.notes(spark, sf_dir), "[0-9]{3}")


@query("WITH s AS (SELECT DISTINCT conv_id AS path FROM conversations) SELECT path, count(*) OVER () AS n FROM s WHERE starts_with(path::VARCHAR, '1')")
def id_prefix(spark, sf_dir):
    return index.by_prefix(A.messages(spark, sf_dir), "1")


@query("""
SELECT count(DISTINCT conv_id) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) AS messages, 1 AS schema_version FROM conversations
""")
def index_status(spark, sf_dir):
    rows = A.messages(spark, sf_dir)
    files = rows.groupBy("path").agg(F.sum(F.octet_length("text")).cast("long").alias("size"))
    return index.totals(files, rows)


def _listing(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.length("html").cast("long").alias("size"), (F.col("page_id") * 1.5).cast("double").alias("mtime_ms"))


@query("""
WITH l AS (SELECT page_id AS path, length(html) AS size, page_id * 1.5 AS m FROM pages),
k AS (SELECT path, CASE WHEN path % 7 = 0 THEN size + 1 ELSE size END AS size, m FROM l WHERE path % 5 <> 0), n AS (SELECT * FROM l WHERE path % 11 <> 0)
SELECT coalesce(k.path, n.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN k.size <> n.size THEN 'changed' ELSE 'same' END AS action
FROM k FULL JOIN n ON k.path = n.path
""")
def delta_refresh(spark, sf_dir):
    now = _listing(spark, sf_dir)
    known = now.filter("path % 5 <> 0").withColumn("size", F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return index.delta(known, now.filter("path % 11 <> 0"))


@query("SELECT conv_id AS path, turn AS seq, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE role END AS role FROM conversations")
def index_upsert(spark, sf_dir):
    rows = A.messages(spark, sf_dir).select("path", "seq", "role")
    return index.upsert(rows, rows.filter("path % 3 = 0").withColumn("role", F.lit("new")), "path", "seq")


@query("SELECT event_id AS id, (epoch_us(ts) // 1000) AS time_updated FROM events WHERE (epoch_us(ts) // 1000, event_id) > ((SELECT epoch_us(ts) // 1000 FROM events WHERE event_id = 500), 500)")
def index_cursor(spark, sf_dir):
    rows = A.dated_messages(spark, sf_dir).select(F.col("seq").alias("id"), F.col("time_ms").alias("time_updated"))
    at = rows.filter("id = 500").first()
    return index.after_cursor(rows, at["time_updated"], at["id"])


@query("SELECT conv_id AS session_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def index_migrated(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role")
    return index.without_migrated(rows.select("session_id", "turn"), rows.filter("role = 'system'"))


@query("""
SELECT url, 'lake://web/' || regexp_extract(url, '([^/\\\\]+?)(\\.[A-Za-z0-9]+)?$', 1) AS address FROM pages
""")
def session_address(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("url", index.address("lake", F.lit("web"), F.col("url")).alias("address"))


@query(f"""
SELECT conv_id AS path, turn AS seq,
  CASE WHEN length(text) <= 240 THEN text ELSE
    CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, e - s) || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS excerpt
FROM (
  SELECT *, CASE WHEN least(s + 240 - (s > 0)::INT, length(text)) < length(text) THEN least(s + 240 - (s > 0)::INT, length(text)) - 1 ELSE length(text) END AS e FROM (
    SELECT *, least(greatest(0, instr(lower(text), '{TERM}') - 1 - {(240 - len(TERM) - 2) // 2}), greatest(0, length(text) - 239)) AS s
    FROM conversations WHERE {VISIBLE} AND contains(lower(text), '{TERM}')))
""")
def match_excerpts(spark, sf_dir):
    rows = search.visible(A.messages(spark, sf_dir)).filter(T.has(F.col("text"), TERM))
    return rows.select("path", "seq", T.excerpt(F.col("text"), [TERM]).alias("excerpt"))


@query()
def chunk_notes(spark, sf_dir):
    rows = A.notes(spark, sf_dir).select(F.col("path").cast("string").alias("path"), F.concat(F.lit("note-"), F.col("path").cast("string")).alias("name"), "text")
    return notes.chunk_notes(rows).select("path", "chunk_no", "sha", "withheld")


@query(ORACLE_SQL["search_rank"])
def search_indexed(spark, sf_dir):
    """Through the index kept in the shared folder, built when first asked for."""
    rows = search.visible(A.messages(spark, sf_dir))
    kept = stored_index.of_files(spark, rows, f"{sf_dir}/conversations.parquet", f"{shared_root(spark)}/threadlake/search-index")
    return kept.rank(rows, TERM)


@query(f"""
WITH p AS (SELECT conv_id AS path, max(turn) AS seq, arg_max(trim(text), turn) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT ({_PREFIX_SQL}) GROUP BY conv_id)
SELECT path, seq, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 299) || '…' END AS request FROM p
""")
def last_requests(spark, sf_dir):
    return find.last_requests(A.messages(spark, sf_dir))


@query("SELECT vec_id AS id, sha256(vec_id::VARCHAR) AS sha FROM embeddings WHERE vec_id % 50 < 40")
def queue_match_batch(spark, sf_dir):
    queue = _queue(spark, sf_dir).withColumn("sha", F.sha2(F.col("id").cast("string"), 256)).withColumn("pos", F.col("id") % 50)
    results = queue.filter("pos < 40").select("batch_id", "pos", "vec")  # a batch that came back in part
    return notes.match_batch(queue, results).select("id", "sha")


@query(
    """
WITH t AS (
  SELECT conv_id::VARCHAR AS path, turn AS line, turn % 3 = 2 AS dropped, text,
    CASE WHEN turn % 3 = 2 THEN ['[redacted]'] ELSE string_split(text, chr(10)) END AS lines
  FROM conversations
), k AS (SELECT *, list_filter(lines, lambda l: NOT contains(lower(l), 'tion') AND NOT contains(lower(l), 'that')) AS kept FROM t),
j AS (SELECT *, coalesce(len(lines) - len(kept), 0) AS cut, array_to_string(kept, chr(10)) AS rest FROM k)
SELECT path, line, cut AS pattern_lines, text IS NOT NULL AND (cut > 0 OR array_to_string(lines, chr(10)) <> text) AS changed,
  CASE WHEN text IS NULL THEN NULL WHEN cut > 0 AND trim(rest) = '' THEN '[redacted]' ELSE rest END AS text
FROM j
"""
)
def scrub_events(spark, sf_dir):
    """Every third turn dropped, lines that hold a literal taken out of the others."""
    rows = A.messages(spark, sf_dir)
    said = F.struct("role", F.col("text").alias("content")).alias("message")
    lines = rows.select("path", F.col("seq").alias("line"), F.to_json(F.struct(said)).alias("value"))
    done = scrub.scrub_lines(lines, lines.filter("line % 3 = 2").select("path", "line"), [" Tion ", "that", "  "])
    return done.select("path", "line", F.get_json_object("value", "$.message.content").alias("text"), "changed", "pattern_lines")


@query("SELECT DISTINCT conv_id AS path FROM conversations WHERE conv_id NOT IN (3, 5, 8)")
def session_exclude(spark, sf_dir):
    return index.exclude(A.messages(spark, sf_dir).select("path").distinct(), ["3", "5", "8", "none"])


_STORES = f"""
m AS (
  SELECT 'chat' AS source, conv_id::VARCHAR AS path, turn AS seq, role, text,
    CASE WHEN conv_id % 3 = 2 OR (conv_id % 3 = 1 AND turn % 2 = 0) THEN strftime(DATE '2024-01-01' + (conv_id % 7)::INT, '%Y-%m-%d') ELSE '' END AS date, NULL::BIGINT AS time_ms, '/work/team-' || (conv_id % 4) AS project FROM conversations
  UNION ALL SELECT 'log', user_id::VARCHAR, event_id, CASE event_type WHEN 'error' THEN 'assistant' ELSE 'user' END, props, strftime(ts, '%Y-%m-%d'), epoch_us(ts) // 1000, '/work/web' FROM events
  UNION ALL SELECT 'docs', doc_id::VARCHAR, 0, 'assistant', text, '', NULL, source FROM documents
), v AS (SELECT * FROM m WHERE {VISIBLE}),
x AS (SELECT * FROM v WHERE role <> 'user' OR (trim(text) <> '' AND NOT ({_PREFIX_SQL})))"""


@query(f"""
WITH {_STORES}, h AS (
  SELECT *, {_occ("text", TERM)} AS hits FROM v
  WHERE contains(lower(text), '{TERM}') AND contains(lower(project), 'work') AND path NOT IN ('1', '2') AND (date = '' OR date >= '2024-01-03')
), b AS (
  SELECT source, path, sum(hits)::BIGINT AS count, coalesce(max(nullif(date, '')), 'unknown') AS date, max(project) AS project FROM h GROUP BY source, path
  ORDER BY count DESC, date DESC, source, path LIMIT 10
), s AS (SELECT source, path, role, text, instr(lower(text), '{TERM}') - 1 AS spot, row_number() OVER (PARTITION BY source, path ORDER BY seq) AS n FROM h)
SELECT source, path, project, date, count, n::INT AS n, role,
  CASE WHEN spot > 100 THEN '...' ELSE '' END || substr(text, greatest(0, spot - 100) + 1, least(length(text), spot + {len(TERM)} + 100) - greatest(0, spot - 100))
  || CASE WHEN spot + {len(TERM)} + 100 < length(text) THEN '...' ELSE '' END AS snippet
FROM b JOIN s USING (source, path) WHERE n <= 3
""")
def stores_search(spark, sf_dir):
    return sessions.search_sessions(A.store_messages(spark, sf_dir), TERM, sessions.Legs(since="2024-01-03", project="WORK", exclude=("1", "2")))


_STORE_TERMS = ["tion", "the", '"k": 1']
_ANY_TERM = " OR ".join(f"contains(lower(text), '{t}')" for t in _STORE_TERMS)


@query(f"""
WITH {_STORES}, d AS (
  SELECT source, path, coalesce(a.own, max(nullif(v.date, '')), 'unknown') AS as_of, max(v.project) AS project
  FROM v JOIN (SELECT source, path, max(nullif(date, '')) AS own FROM x WHERE {_ANY_TERM} GROUP BY source, path) a USING (source, path) GROUP BY source, path, a.own
), s AS (
  SELECT source, path, term, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a
  FROM x, (SELECT unnest([{", ".join(f"'{t}'" for t in _STORE_TERMS)}]) AS term) WHERE contains(lower(text), term) GROUP BY ALL
), c AS (
  SELECT source, path, as_of, d.project, count(*) AS n, min(u + a) AS low, sum(u + a) AS total, sum(5 * u + a)::BIGINT AS score, list(term) AS matched
  FROM s JOIN d USING (source, path) WHERE as_of = 'unknown' OR as_of >= '2024-01-05' GROUP BY ALL ORDER BY n DESC, low DESC, total DESC, source, path LIMIT 40
), t AS (SELECT matched AS required FROM c ORDER BY n DESC, score DESC, source, path LIMIT 1)
SELECT source, path, project, as_of AS date, score FROM c, t WHERE len(list_intersect(matched, required)) = len(required) ORDER BY n DESC, score DESC, source, path LIMIT 30
""")
def stores_find_since(spark, sf_dir):
    """Sessions whose matches have no date stay by the date of their other
    messages, and those without any date stay."""
    found = sessions.find_sessions(A.store_messages(spark, sf_dir), _STORE_TERMS, sessions.Legs(since="2024-01-05"), limit=30)
    return found.select("source", "path", "project", "date", "score")


@query(f"""
WITH {_STORES}, g AS (
  SELECT source, path, coalesce(max(nullif(date, '')), '') AS date, max(time_ms) AS time_ms, max(project) AS project FROM v GROUP BY source, path HAVING coalesce(max(nullif(date, '')), '') >= '2024-01-04'
), n AS (SELECT *, count(*) OVER () AS total FROM g ORDER BY date DESC, time_ms DESC NULLS LAST, source, path LIMIT 20),
p AS (SELECT source, path, arg_max(trim(text), seq) AS t FROM x WHERE role = 'user' GROUP BY source, path)
SELECT source, path, project, date, time_ms, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 299) || '…' END AS request, total FROM n LEFT JOIN p USING (source, path)
""")
def stores_last(spark, sf_dir):
    return sessions.last_sessions(A.store_messages(spark, sf_dir), sessions.Legs(since="2024-01-04"), limit=20)


NOTE_SELECTORS = ["fr-1", "src3/en-7", "src0", "src1", "rc", "nowhere"]
_NOTE_TIER = "CASE WHEN path = s THEN 1 WHEN project = s OR project || '/' || name = s OR contains(project, s) THEN 2 END"


@query(f"""
WITH n AS (SELECT lang || '-' || doc_id AS path, coalesce(source, '') AS project, CASE WHEN doc_id % 90 = 4 THEN 'MEMORY.md' ELSE lang || '-' || doc_id END AS name FROM documents),
s AS (SELECT unnest({NOTE_SELECTORS}) AS s), m AS (SELECT s, path, name, {_NOTE_TIER} AS tier FROM s, n WHERE {_NOTE_TIER} IS NOT NULL),
b AS (SELECT s, path, name FROM m JOIN (SELECT s, min(tier) AS tier FROM m GROUP BY s) USING (s, tier))
SELECT s AS selector, CASE WHEN count(path) = 1 THEN min(path) ELSE min(path) FILTER (name = 'MEMORY.md') END AS path, count(path) AS n FROM s LEFT JOIN b USING (s) GROUP BY s
""")
def select_notes(spark, sf_dir):
    return selectors.select_notes(A.named_notes(spark, sf_dir), NOTE_SELECTORS)


SESSION_IDS = ["u-1", "U-22", "u-5", "u-none"]
_LOG = "CASE event_type WHEN 'error' THEN '/log/u-' || user_id || '/subagents/' || event_id % 9 || '.jsonl' WHEN 'purchase' THEN 'C:\\log\\U-' || user_id || '.jsonl' ELSE '/log/u-' || user_id || '.jsonl' END"


@query(f"""
WITH p AS (SELECT {_LOG} AS path, max(strftime(ts, '%Y-%m-%d')) AS date, max(epoch_us(ts) // 1000) AS time_ms FROM events GROUP BY 1),
s AS (SELECT unnest({SESSION_IDS}) AS s)
SELECT s AS selector, (SELECT path FROM p WHERE contains(lower(path), lower(s)) ORDER BY contains(replace(lower(path), chr(92), '/'), '/' || lower(s) || '.jsonl') DESC,
  NOT contains(replace(path, chr(92), '/'), '/subagents/') DESC, date DESC, time_ms DESC, path DESC LIMIT 1) AS path FROM s
""")
def find_by_id(spark, sf_dir):
    return selectors.sessions_by_id(A.log_files(spark, sf_dir), SESSION_IDS)


@query("""
SELECT conv_id AS path, turn AS idx, length(t) AS n, sha256(t) AS sha FROM (
  SELECT *, CASE WHEN role = 'user' THEN role || ' result: ' || coalesce(text, '') ELSE concat_ws(' ', role || ':', nullif(text, ''), nullif(role, ''), turn, 2 * turn + 0.5, conv_id % 2 = 0) END AS t FROM conversations)
""")
def tool_text(spark, sf_dir):
    found = calls.texts(A.nested_calls(spark, sf_dir))
    return found.select("path", "idx", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))


@query(f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN role || ' result: ' || coalesce(text, '') ELSE concat_ws(' ', role || ':', nullif(text, ''), nullif(role, ''), turn, 2 * turn + 0.5, conv_id % 2 = 0) END AS text FROM conversations),
h AS (SELECT *, {_occ("text", TERM)} AS hits, instr(lower(text), '{TERM}') - 1 AS spot FROM t WHERE contains(lower(text), '{TERM}')),
r AS (SELECT conv_id, sum(hits)::BIGINT AS count, min(turn) AS turn FROM h GROUP BY conv_id ORDER BY count DESC, conv_id LIMIT 10)
SELECT conv_id AS path, count, turn AS idx, CASE WHEN spot > 100 THEN '...' ELSE '' END || substr(text, greatest(0, spot - 100) + 1, least(length(text), spot + {len(TERM)} + 100) - greatest(0, spot - 100))
  || CASE WHEN spot + {len(TERM)} + 100 < length(text) THEN '...' ELSE '' END AS snippet
FROM r JOIN h USING (conv_id, turn)
""")
def search_calls(spark, sf_dir):
    return calls.search(A.nested_calls(spark, sf_dir), TERM)


@query("""
WITH l AS (SELECT lang, source, substr(text, 1, 24) AS label FROM documents WHERE text IS NOT NULL)
SELECT lang, source, list(label ORDER BY label COLLATE en, label)[1] AS first, list(label ORDER BY label COLLATE en, label)[-1] AS last, min(label) AS least FROM l GROUP BY ALL
""")
def labels_in_order(spark, sf_dir):
    """The first and last opening of a text by collation, and the least by units."""
    label = F.substring("text", 1, 24)
    rows = A.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", "source", label.alias("label"))
    named = F.struct(order.total_order(F.col("label")), F.col("label"))
    found = rows.groupBy("lang", "source").agg(F.min(named).alias("a"), F.max(named).alias("z"), F.min(F.struct(order.by_units(F.col("label")), F.col("label"))).alias("u"))
    return found.select("lang", "source", F.col("a.label").alias("first"), F.col("z.label").alias("last"), F.col("u.label").alias("least"))
