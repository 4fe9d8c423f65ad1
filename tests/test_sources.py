import json
import sqlite3

import pytest

from threadlake.sources import note_files, sqlite, transcripts
from threadlake.streaming import refresh


def test_lenient_lines():
    parse = transcripts.parse_line
    assert parse("claude", "not json") == [] and parse("claude", "[1]") == []
    user = {"type": "user", "uuid": "u1", "parentUuid": None, "cwd": "/w", "message": {"role": "user", "content": "hi"}}
    (event,) = parse("claude", json.dumps(user))
    assert (event["kind"], event["text"], event["node_id"], event["project"]) == ("user", "hi", "u1", "/w")
    assert parse("claude", '{"type":"user","message":{"role":5,"content":"x"},"uuid":"a"}')[0]["kind"] == "meta"
    assert parse("claude", '{"type":"user","type":"assistant","message":{"role":"assistant","content":"x"}}')[0]["kind"] == "assistant"
    blocks = {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "c", "name": "read", "input": {"p": 1}}]}}
    assert [e["kind"] for e in parse("claude", json.dumps(blocks))] == ["thinking", "tool_call"]
    out = parse("codex", json.dumps({"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": " Error: no"}}))
    assert out[0]["is_error"] and out[0]["call_id"] == "c"
    pi = parse("pi", json.dumps({"type": "message", "id": "1", "message": {"role": "toolResult", "toolCallId": "c", "content": [{"type": "text", "text": "ok"}], "isError": True}}))
    assert (pi[0]["kind"], pi[0]["output"], pi[0]["is_error"]) == ("tool_result", "ok", True)
    agy = parse("agy", json.dumps({"type": "USER_INPUT", "content": "<USER_REQUEST>\ndo it\n</USER_REQUEST>"}))
    assert agy[0]["text"] == "do it"
    assert parse("droid", json.dumps({"visibility": "llm_only", "message": {"role": "user", "content": "x"}})) == []


def _log(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def _turn(node, parent, role, text):
    return {"type": role, "uuid": node, "parentUuid": parent, "timestamp": "2024-05-01T10:00:00Z", "cwd": "/w", "message": {"role": role, "content": text}}


def test_branch_and_messages(spark, tmp_path):
    _log(tmp_path / "logs/a.jsonl", _turn("1", None, "user", "root"), _turn("2", "1", "assistant", "abandoned"), "bad line", _turn("3", "1", "assistant", "active"))
    lines = transcripts.raw_lines(spark, str(tmp_path / "logs"), "claude")
    found = transcripts.events(lines)
    assert {r.line for r in found.collect()} == {1, 2, 4}
    kept = transcripts.active_branch(found)
    got = transcripts.messages(kept).orderBy("seq").collect()
    assert [(r.role, r.text, r.date, r.project) for r in got] == [("user", "root", "2024-05-01", "/w"), ("assistant", "active", "2024-05-01", "/w")]


def test_cycle_ends(spark):
    rows = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "b", "a")], "path string, line long, node_id string, parent_id string")
    assert transcripts.active_branch(rows).count() == 2


def test_sqlite_source(spark, tmp_path):
    db = tmp_path / "x.db"
    con = sqlite3.connect(db)
    con.execute("create table message (id text primary key, data text)")
    con.executemany("insert into message values (?, ?)", [(f"m{k}", json.dumps({"role": "user"})) for k in range(5)])
    con.commit()
    con.close()
    got = sqlite.read_table(spark, [str(db)], "message").collect()
    assert sorted(json.loads(r.value)["id"] for r in got) == [f"m{k}" for k in range(5)]
    assert sqlite.read_table(spark, [str(db)], "absent").count() == 0


def test_note_files(spark, tmp_path):
    for name, text in (("p1/memory/a.md", "﻿alpha"), ("p1/memory/.hidden.md", "x"), ("p1/other/b.md", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = note_files.memories(spark, str(tmp_path)).collect()
    assert [(r.project, r.name, r.text) for r in got] == [("p1", "a.md", "alpha")]


def _texts(spark, table):
    return sorted(r.text for r in refresh.messages(spark, table).collect())


def test_refresh_follows_growing_logs(spark, tmp_path):
    root, table = tmp_path / "my logs", str(tmp_path / "table")
    root.mkdir()
    assert refresh.refresh(spark, str(root), "claude", table) == {} and _texts(spark, table) == []
    _log(root / "a.jsonl", _turn("1", None, "user", "one"))
    _log(root / "sub/b.jsonl", _turn("1", None, "user", "two"))
    assert refresh.refresh(spark, str(root), "claude", table) == {"new": 2, "lines": 2}
    assert refresh.refresh(spark, str(root), "claude", table) == {"same": 2}
    # appended, with a last line that is still being written
    with (root / "a.jsonl").open("a") as out:
        out.write(json.dumps(_turn("2", "1", "assistant", "three")) + "\n" + json.dumps(_turn("3", "2", "user", "four"))[:30])
    assert refresh.refresh(spark, str(root), "claude", table) == {"grown": 1, "same": 1, "lines": 1}
    assert _texts(spark, table) == ["one", "three", "two"]
    with (root / "a.jsonl").open("a") as out:
        out.write(json.dumps(_turn("3", "2", "user", "four"))[30:] + "\n")
    refresh.refresh(spark, str(root), "claude", table)
    assert _texts(spark, table) == ["four", "one", "three", "two"]
    # rewritten shorter, and vanished
    _log(root / "a.jsonl", _turn("1", None, "user", "anew"))
    (root / "sub/b.jsonl").unlink()
    assert refresh.refresh(spark, str(root), "claude", table) == {"rewritten": 1, "gone": 1, "lines": 1}
    assert _texts(spark, table) == ["anew"]
    (root / "a.jsonl").unlink()
    refresh.refresh(spark, str(root), "claude", table)
    assert _texts(spark, table) == []


def test_refresh_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    _log(root / "a.jsonl", _turn("1", None, "user", "one"))
    refresh.refresh(spark, str(root), "claude", table)
    _log(root / "a.jsonl", _turn("1", None, "user", "two"), _turn("2", "1", "user", "more"))
    parse = transcripts.messages

    def fails(found):
        parse(found).write.mode("append").parquet(f"{table}/messages/batch=half")
        raise OSError("lost before the list was written")

    monkeypatch.setattr(transcripts, "messages", fails)
    with pytest.raises(OSError):
        refresh.refresh(spark, str(root), "claude", table)
    monkeypatch.setattr(transcripts, "messages", parse)
    assert _texts(spark, table) == ["one"]
    refresh.refresh(spark, str(root), "claude", table)
    assert _texts(spark, table) == ["more", "two"]


def test_daily_activity_closes_days(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-05 00:00:00", "b")]
    spark.createDataFrame(rows, "ts string, event_type string").write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string").json(str(tmp_path / "in"))
    query = refresh.daily_activity(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.date_format("day.start", "yyyy-MM-dd"), "event_type", "n").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", "a", 2)]
