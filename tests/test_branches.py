"""Branches with hooks and summaries, folders of conversations, percent coding."""

import json
import sqlite3

from pyspark.sql import functions as F

from threadlake.functions import paths
from threadlake.sources import registry, transcripts
from threadlake.sources.discovery import Store


def _lines(spark, source, rows, path="s"):
    return spark.createDataFrame([(path, source, k + 1, json.dumps(r)) for k, r in enumerate(rows)], "path string, source string, line long, value string")


def _said(id, text, parent=None, role="user", **more):
    return {"type": "message", "id": id, **({"parentId": parent} if parent else {}), "message": {"role": role, "content": [{"type": "text", "text": text}]}, **more}


DROID = [
    {"type": "session_start", "id": "s", "cwd": "/work/x"},
    _said("a", "one"),
    _said("b", "abandoned", "a", "assistant"),
    _said("l", "the harness speaks", "a", visibility="llm_only"),
    _said("c", "two\n<system-notification>skill</system-notification>", "l"),
    _said("c", "three", "c", "assistant"),
    {"type": "compaction_state", "id": "z", "summaryKind": "llm_summary", "summaryText": "what was said", "removedCount": 4},
    {"type": "compaction_state", "id": "y", "summaryKind": "provider_switch_serialization", "summaryText": "no"},
    _said("d", "<system-reminder>tools</system-reminder>", "c"),
    _said("e", "four", "d"),
    {"type": "agent_turn_outcome", "id": "q"},
    _said("h", "bye", hookEventName="SessionEnd"),
]


def _shown(spark, rows, source="droid"):
    kept = transcripts.active_branch(transcripts.events(_lines(spark, source, rows)))
    return [r.text for r in transcripts.messages(kept).orderBy("seq").collect()]


def test_hooks_are_no_leaf_and_summaries_stay(spark):
    assert _shown(spark, DROID) == ["one", "two", "three", "[Compaction summary of 4 earlier messages]\n\nwhat was said", "four"]
    kept = transcripts.active_branch(transcripts.events(_lines(spark, "droid", DROID)))
    assert {r.project for r in transcripts.messages(kept).collect()} == {"/work/x"}
    assert "place" in kept.columns and kept.filter("line = 4").count() == 1, "hidden rows hold the chain together"


def test_sessions_of_a_summary_or_of_hooks_only(spark):
    assert _shown(spark, [{"type": "compaction_state", "summaryKind": "llm_summary", "summaryText": "all", "removedCount": True}]) == ["[Compaction summary]\n\nall"]
    assert _shown(spark, [_said("h", "bye", hookEventName="SessionEnd")]) == []
    assert _shown(spark, [{"type": "compaction_state", "summaryKind": "llm_summary", "summaryText": " \n"}]) == []


def test_codex_summaries(spark):
    rows = [
        {"type": "compacted", "payload": {"message": "so far", "replacement_history": []}},
        {"type": "compacted", "payload": {"message": ""}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go on"}]}},
    ]
    assert _shown(spark, rows, "codex") == ["[Compaction summary]\n\nso far", "go on"]


def test_long_walks_over_repeated_ids(spark):
    rows = [_said("same", f"n{k}", "same") for k in range(3000)]
    assert len(_shown(spark, rows)) == 3000


def test_percent_coding(spark):
    texts = ["a%20b", "100%", "%zz%41", "a+b", "%C3%BC", "%", "", "%e2%82%ac/%2"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in table.select(paths.percent_decode(F.col("t")).alias("d")).collect()]
    assert got == ["a b", "100%", "%zzA", "a+b", "ü", "%", "", "€/%2"]
    plain = ["ü b+c", "a/b?c=d&e", "!*'()~-_.", "%", "\U0001f600"]
    rows = spark.createDataFrame([(t,) for t in plain], "t string").select("t", paths.encode_component(F.col("t")).alias("e"))
    assert [r.e for r in rows.collect()] == ["%C3%BC%20b%2Bc", "a%2Fb%3Fc%3Dd%26e", "!*'()~-_.", "%25", "%F0%9F%98%80"]
    assert rows.filter(paths.decode_component(F.col("e")) != F.col("t")).count() == 0
    assert table.filter(paths.decode_component(F.col("t")).isNull()).count() == 4


def test_folders_of_conversations(spark, tmp_path):
    base = tmp_path / "cli"
    for name in ("c1", "c2", "c3", "c4"):
        (base / "brain" / name).mkdir(parents=True)
        (base / "brain" / name / "log.jsonl").write_text(json.dumps({"type": "USER_INPUT", "source": "USER_EXPLICIT", "content": f"hello {name}", "created_at": "2026-01-02T03:04:05Z"}) + "\n")
    store = Store("agy", "jsonl", str(base / "brain"))
    projects = lambda: {r.text[-2:]: r.project for r in registry.union(spark, [store]).collect()}
    assert projects() == {"c1": "", "c2": "", "c3": "", "c4": ""}, "no table and no history"
    con = sqlite3.connect(base / "conversation_summaries.db")
    con.execute("create table conversation_summaries (conversation_id text, workspace_uris text)")
    con.executemany("insert into conversation_summaries values (?, ?)", [("c1", '["file:///work/a%20b", "file:///other"]'), ("c2", '["file:///C:/w"]'), ("c3", '["vscode://x"]'), ("c4", "no json")])
    con.commit()
    con.close()
    history = [{"conversationId": "c1", "workspace": "/late"}, {"conversationId": "c3", "workspace": "/first"}, {"conversationId": "c3", "workspace": "/second"}, {"conversationId": "c4", "workspace": ""}]
    (base / "history.jsonl").write_text("not json\n" + "\n".join(map(json.dumps, history)))
    assert projects() == {"c1": "/work/a b", "c2": "C:/w", "c3": "/first", "c4": ""}
    assert {r.project for r in registry.union(spark, [store], asked=registry.Asked(project="FIRST")).collect()} == {"/first"}
