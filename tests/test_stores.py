"""Readers, composites over several stores, tail appends and the stored index."""

import json
import os
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F
from test_sources import _log, _turn

from threadlake.operators import search, sessions, stored_index
from threadlake.sources import log_ranges, registry
from threadlake.sources.discovery import Store
from threadlake.streaming import refresh, versions


def _stores(tmp_path):
    """A log agent, a database agent and a chat database."""
    _log(tmp_path / "claude/-home-my-app/a.jsonl", _turn("1", None, "user", "fix the parser"), _turn("2", "1", "assistant", "the parser is fixed, parser done"))
    _log(tmp_path / "claude/-home-other/b.jsonl", _turn("1", None, "user", "nothing here"))
    con = sqlite3.connect(tmp_path / "o.db")
    con.executescript("create table message (id text, session_id text, time_created int, data text); create table part (id text, message_id text, session_id text, time_created int, data text); create table session_message (id text, session_id text, type text, seq int, time_created int, data text);")
    con.execute("insert into session_message values ('s1','ses_1','user',1,1600000000000,?)", (json.dumps({"text": "an old parser question"}),))
    con.execute("insert into session_message values ('s2','ses_2','user',1,1750000000000,?)", (json.dumps({"text": "a new Parser question"}),))
    con.commit()
    con.close()
    con = sqlite3.connect(tmp_path / "h.db")
    con.execute("create table messages (id integer primary key, session_id text, role text, content text, timestamp real, active int)")
    con.execute("insert into messages values (1,'h1','user','no date, parser',null,1)")
    con.commit()
    con.close()
    return [Store("claude", "jsonl", str(tmp_path / "claude")), Store("opencode", "sqlite", str(tmp_path / "o.db")), Store("hermes", "sqlite", str(tmp_path / "h.db"))]


def _names(rows):
    return {(r.source, os.path.basename(r.path)) for r in rows.collect()}


def test_union_of_readers(spark, tmp_path):
    stores = _stores(tmp_path)
    rows = registry.union(spark, stores)
    assert rows.columns == registry.COLUMNS
    assert _names(rows) == {("claude", "a.jsonl"), ("claude", "b.jsonl"), ("opencode", "o.db#ses_1"), ("opencode", "o.db#ses_2"), ("hermes", "h.db#h1")}
    assert _names(registry.union(spark, stores, "hermes")) == {("hermes", "h.db#h1")}
    with pytest.raises(ValueError, match="no transcript stores"):
        registry.union(spark, stores, "codex")
    with pytest.raises(ValueError, match="no reader"):
        registry.union(spark, [Store("other", "jsonl", "/x")])


def test_a_reader_of_ones_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "_readers", registry.readers())
    seen = []

    def read(session, stores, asked):
        seen.append((len(stores), asked.since))
        return registry.shaped(session.createDataFrame([("p", 1, "user", "mine")], "path string, seq long, role string, text string"), "mine")

    registry.register("mine", read)
    rows = registry.union(spark, [Store("mine", "other", "/a"), Store("mine", "other", "/b")], asked=registry.Asked(since="2024-01-01"))
    assert seen == [(2, "2024-01-01")] and [(r.source, r.date, r.project) for r in rows.collect()] == [("mine", "", "")]


def test_old_files_are_not_opened(spark, tmp_path):
    stores = _stores(tmp_path)
    os.utime(tmp_path / "claude/-home-other/b.jsonl", (1, 1))
    rows = registry.union(spark, stores, "claude", registry.Asked(since="2024-01-01"))
    assert _names(rows) == {("claude", "a.jsonl")}


def test_projects_fold_hyphens_for_some_agents(spark):
    rows = spark.createDataFrame([("claude", "-home-my-app"), ("codex", "-home-my-app"), ("codex", "/home/my/app")], "source string, project string")
    assert [(r.source, r.project) for r in registry.in_project(rows, "MY/app").collect()] == [("claude", "-home-my-app"), ("codex", "/home/my/app")]


def test_composites_over_three_kinds(spark, tmp_path):
    rows = registry.union(spark, _stores(tmp_path)).cache()
    found = sessions.search_sessions(rows, " parser ").collect()
    assert [(os.path.basename(r.path), r["count"], r.n) for r in sorted(found, key=lambda r: (-r["count"], r.path, r.n))][:2] == [("a.jsonl", 3, 1), ("a.jsonl", 3, 2)]
    assert _names(sessions.search_sessions(rows, "parser", sessions.Legs(since="2024-06-01"))) == {("opencode", "o.db#ses_2"), ("hermes", "h.db#h1")}
    assert _names(sessions.search_sessions(rows, "parser", sessions.Legs(source="opencode", exclude=("ses_1",)))) == {("opencode", "o.db#ses_2")}
    assert _names(sessions.search_sessions(rows, "parser", sessions.Legs(project="/w"))) == {("claude", "a.jsonl")}
    with pytest.raises(ValueError, match="empty"):
        sessions.search_sessions(rows, "  ")
    best = sessions.find_sessions(rows, ["parser", "fixed"]).collect()
    assert [(os.path.basename(r.path), r.date, r.matched, r.opening) for r in best] == [("a.jsonl", "2024-05-01", "parser|fixed", "fix the parser")]
    assert _names(sessions.find_sessions(rows, ["parser"], sessions.Legs(since="2025-01-01"))) == {("opencode", "o.db#ses_2"), ("hermes", "h.db#h1")}
    last = sessions.last_sessions(rows, limit=2).orderBy(F.desc("date")).collect()
    assert [(os.path.basename(r.path), r.request, r.total) for r in last] == [("o.db#ses_2", "a new Parser question", 5), ("a.jsonl", "fix the parser", 5)]
    rows.unpersist()


def test_dates_fall_back(spark):
    schema = registry.MESSAGES + ", created string"
    made = lambda p, seq, text, date, created=None: ("s", p, seq, "assistant", text, date, None, "", created)
    rows = spark.createDataFrame(
        [
            made("match dated", 1, "term", "2024-01-01"), made("match dated", 2, "x", "2025-01-01"),
            made("match undated, other new", 1, "term", ""), made("match undated, other new", 2, "x", "2025-01-01"),
            made("match undated, other old", 1, "term", "unknown"), made("match undated, other old", 2, "x", "2023-01-01"),
            made("created old", 1, "term", "", "2020-01-01"), made("no date", 1, "term", ""),
        ],
        schema,
    )
    got = {r.path: r.as_of for r in sessions.session_dates(rows, rows.filter("text = 'term'")).collect()}
    assert got == {"match dated": "2024-01-01", "match undated, other new": "2025-01-01", "match undated, other old": "2023-01-01", "created old": "2020-01-01", "no date": "unknown"}
    kept = {r.path for r in sessions.find_sessions(rows, ["term"], sessions.Legs(since="2024-06-01")).collect()}
    assert kept == {"match undated, other new", "no date"}
    assert {r.path for r in sessions.active_since(rows, "2024-06-01").collect()} == {"match dated", "match undated, other new"}


# --- ranges ----------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_is_read_once(spark, tmp_path, size):
    text = "﻿first\r\n\nzwei ä\n" + "x" * 100 + "\nlast without end"
    (tmp_path / "a.log").write_text(text, encoding="utf-8", newline="")
    n = (tmp_path / "a.log").stat().st_size
    part = spark.createDataFrame([("a", f"file://{tmp_path}/a.log", 0, n)], "path string, file string, start long, stop long")
    want, at = [], 0
    for line in text.encode().split(b"\n"):
        want.append((at, line.decode().lstrip("﻿").rstrip("\r")))
        at += len(line) + 1
    read = lambda **how: sorted((r.line, r.value) for r in log_ranges.read_lines(part, "claude", size, **how).collect())
    assert read() == want[:-1] and read(open_end=True) == want


# --- refresh ---------------------------------------------------------------


def test_an_append_reads_the_tail_only(spark, tmp_path):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    _log(root / "a.jsonl", *[_turn(str(k), None, "user", f"line {k}") for k in range(200)])
    assert refresh.refresh(spark, str(root), "claude", table) == {"new": 1, "lines": 200}
    with (root / "a.jsonl").open("a") as out:
        out.write(json.dumps(_turn("x", "1", "assistant", "more")) + "\n" + json.dumps(_turn("y", "1", "user", "half"))[:40])
    assert refresh.refresh(spark, str(root), "claude", table) == {"grown": 1, "lines": 1}
    with (root / "a.jsonl").open("a") as out:
        out.write(json.dumps(_turn("y", "1", "user", "half"))[40:] + "\n")
    assert refresh.refresh(spark, str(root), "claude", table) == {"grown": 1, "lines": 1}
    rows = refresh.messages(spark, table)
    assert rows.count() == 202 and rows.filter("text = 'half' and project = '/w'").count() == 1
    assert rows.select("seq").distinct().count() == 202
    # another head, longer than before: read anew
    _log(root / "a.jsonl", *[_turn(str(k), None, "user", f"other {k}") for k in range(300)])
    assert refresh.refresh(spark, str(root), "claude", table) == {"rewritten": 1, "lines": 300}
    assert refresh.messages(spark, table).filter("text like 'other%'").count() == refresh.messages(spark, table).count() == 300
    assert refresh.refresh(spark, str(root), "claude", table, rebuild=True) == {"new": 1, "lines": 300}
    assert refresh.messages(spark, table).count() == 300


def test_refresh_after_a_failed_version_and_beside_another(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    _log(root / "a.jsonl", _turn("1", None, "user", "one"))
    refresh.refresh(spark, str(root), "claude", table)
    _log(root / "b.jsonl", _turn("1", None, "user", "two"))
    with monkeypatch.context() as broken:
        broken.setattr(versions, "_place", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            refresh.refresh(spark, str(root), "claude", table)
    held = refresh._files(spark, table)
    held.read().write.parquet(f"{table}/files/rows-half")  # written, never published
    assert refresh.refresh(spark, str(root), "claude", table) == {"new": 1, "same": 1, "lines": 1}
    assert sorted(r.text for r in refresh.messages(spark, table).collect()) == ["one", "two"]
    with pytest.raises(versions.AlreadyPublished):
        held.publish(held.read(), held.newest() - 1)
    assert held.newest() == 2


def test_skipped_logs_keep_their_rows(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    _log(root / "a.jsonl", _turn("1", None, "user", "one"))
    _log(root / "b.jsonl", _turn("1", None, "user", "two"))
    refresh.refresh(spark, str(root), "claude", table)
    listed = refresh.listing(spark, str(root))
    away = listed.withColumn("size", F.col("size") + F.when(F.col("path").endswith("a.jsonl"), 5).otherwise(0)).withColumn("file", F.when(F.col("path").endswith("a.jsonl"), F.concat("file", F.lit(".gone"))).otherwise(F.col("file")))
    with monkeypatch.context() as other:
        other.setattr(refresh, "listing", lambda *a: away)
        assert refresh.refresh(spark, str(root), "claude", table) == {"same": 1, "skipped": 1, "lines": 0}
    assert sorted(r.text for r in refresh.messages(spark, table).collect()) == ["one", "two"]
    assert refresh.refresh(spark, str(root), "claude", table) == {"same": 2}


def test_compaction(spark, tmp_path):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    for k in range(3):
        _log(root / "a.jsonl", *[_turn(str(j), None, "user", f"{k}-{j}") for j in range(k + 1)])
        _log(root / f"n{k}.jsonl", _turn("1", None, "user", f"new {k}"))
        refresh.refresh(spark, str(root), "claude", table)
    before = sorted(tuple(r) for r in refresh.messages(spark, table).collect())
    assert len(os.listdir(f"{table}/messages")) == 3 and refresh.compact(spark, table) == 3
    assert sorted(tuple(r) for r in refresh.messages(spark, table).collect()) == before
    assert len([n for n in os.listdir(f"{table}/messages") if n.startswith("batch=")]) == 1
    assert len([n for n in os.listdir(f"{table}/files/published") if n.isdigit()]) == 1
    assert refresh.refresh(spark, str(root), "claude", table) == {"same": 4}


# --- stored index ----------------------------------------------------------


def _rows_scanned(df):
    """Rows that the scans of a query without a shuffle handed on."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        total += leaves.apply(k).metrics().apply("numOutputRows").value()
    return total


def test_stored_index_prunes_and_follows_refreshes(spark, tmp_path):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    many = [_turn(str(k), None, "user", f"message {k} about wordform{k % 37} and {k * 7919 % 1000:03d} things") for k in range(300)]
    _log(root / "a.jsonl", *many)
    refresh.refresh(spark, str(root), "claude", table)
    kept = stored_index.of_table(spark, table)
    assert len(kept.batches()) == 1 and stored_index.of_table(spark, table).manifest.newest() == 1
    everything = spark.read.parquet(f"{table}/trigrams/postings").count()
    assert 0 < _rows_scanned(kept.postings(["838"])) < everything / 10
    rows = refresh.messages(spark, table)
    for term in ("wordform3", "838", "WORDFORM36", "no such thing", "ab"):
        assert kept.rank(rows, term).collect() == search.rank(rows, term).collect()
    with (root / "a.jsonl").open("a") as out:
        out.write(json.dumps(_turn("x", "1", "assistant", "zebra crossing")) + "\n")
    refresh.refresh(spark, str(root), "claude", table)
    grown = stored_index.of_table(spark, table)
    assert len(grown.batches()) == 2 and [r["count"] for r in grown.rank(refresh.messages(spark, table), "zebra").collect()] == [1]
    _log(root / "a.jsonl", _turn("1", None, "user", "all new"))
    refresh.refresh(spark, str(root), "claude", table)
    anew = stored_index.of_table(spark, table)
    assert len(anew.batches()) == 1 and anew.rank(refresh.messages(spark, table), "zebra").count() == 0
    anew.vacuum()
    assert len([n for n in os.listdir(f"{table}/trigrams/postings") if n.startswith("batch=")]) == 1


def test_index_of_another_layout_is_built_anew(spark, tmp_path, monkeypatch):
    data, root = str(tmp_path / "data"), str(tmp_path / "kept")
    rows = spark.createDataFrame([("a", 1, "user", "hello there")], "path string, seq long, role string, text string")
    rows.write.parquet(data)
    first = stored_index.of_files(spark, rows, data, root)
    assert stored_index.of_files(spark, rows, data, root).manifest.newest() == 1
    monkeypatch.setattr(stored_index, "LAYOUT", 2)
    assert first.batches() == []
    again = stored_index.of_files(spark, rows, data, root)
    assert again.manifest.newest() == 2 and again.rank(rows, "there").count() == 1
    more = rows.unionByName(spark.createDataFrame([("b", 1, "user", "there too")], rows.schema))
    spark.createDataFrame([("b", 1, "user", "there too")], rows.schema).write.mode("append").parquet(data)
    assert stored_index.of_files(spark, more, data, root).rank(more, "there").count() == 2


def test_trigrams_of_long_texts_and_few_files(spark, tmp_path):
    """Time in proportion to the length, and no file of every task in every bucket."""
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz 0123456789") for _ in range(400_000))
    texts = ["", "ab", None, "a\U0001f600B\u00e9\u0130x", long]
    rows = spark.createDataFrame([("p", k, t) for k, t in enumerate(texts)], "path string, seq long, text string")
    began = time.time()
    got = {(r.seq, r.trigram) for r in search.trigram_index(rows).collect()}
    assert time.time() - began < 60
    lows = [r[0] or "" for r in rows.orderBy("seq").selectExpr("lower(text)").collect()]
    assert got == {(k, low[i : i + 3]) for k, low in enumerate(lows) for i in range(len(low) - 2)}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = stored_index.StoredIndex(spark, str(tmp_path / "kept"))
        kept.sync(rows.withColumn("batch", F.lit("b")), ["b"])
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = [n for _, _, names in os.walk(tmp_path / "kept" / "postings") for n in names if n.endswith(".parquet")]
    assert 0 < len(files) <= 40 + stored_index.BUCKETS
