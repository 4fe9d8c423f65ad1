"""Selectors, the text of calls, orders of text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadlake.functions import order
from threadlake.operators import calls, notes, selectors

NOTES = [("/m/a/x.md", "work-a", "x.md"), ("/m/a/MEMORY.md", "work-a", "MEMORY.md"), ("/m/b/y.md", "work-b", "y.md"), ("/m/c/z.md", "home", "z.md"), ("work-b", "other", "odd.md"), ("/m/n", None, None)]


def test_select_notes(spark):
    table = spark.createDataFrame(NOTES, "path string, project string, name string")
    asked = ["/m/b/y.md", "work-a", "work-a/x.md", "work", "home", "work-b", "nothing", "o"]
    got = {r.selector: (r.path, r.n) for r in selectors.select_notes(table, asked + ["home"]).collect()}
    assert got == {
        "/m/b/y.md": ("/m/b/y.md", 1),
        "work-a": ("/m/a/MEMORY.md", 2),
        "work-a/x.md": ("/m/a/x.md", 1),
        "work": ("/m/a/MEMORY.md", 3),
        "home": ("/m/c/z.md", 1),
        "work-b": ("work-b", 1),
        "nothing": (None, 0),
        "o": ("/m/a/MEMORY.md", 5),
    }
    assert [r.name for r in selectors.show_note(table, "home").collect()] == ["z.md"]
    with pytest.raises(ValueError, match="no note"):
        selectors.show_note(table, "nothing")
    with pytest.raises(ValueError, match="ambiguous: 2"):
        selectors.show_note(table.filter("name = 'x.md' or name = 'y.md'"), "work")
    assert selectors.select_notes(table.limit(0), ["x"]).collect()[0].n == 0 and selectors.select_notes(table, []).count() == 0


def test_sessions_by_id(spark):
    rows = [
        ("claude", "/s", "/s/p/AB12.jsonl", "2024-01-01", 1),
        ("claude", "/s", "/s/p/AB12/subagents/h.jsonl", "2024-05-01", 9),
        ("pi", "/pi", "/pi/p/cd34.jsonl", "2024-01-01", 1),
        ("pi", "/pi", "/pi/p/xcd34/h.jsonl", "2024-06-01", 2),
        ("claude", "/s", "C:\\s\\p\\ef56.jsonl", "", None),
        ("claude", "/s", "/s/p/ef56-more.jsonl", "2024-06-01", 2),
        ("claude", "/s", "/s/p/g1-gh78.jsonl", "2024-06-01", 2),
        ("claude", "/s", "/s/p/g2-gh78.jsonl", "unknown", 5),
    ]
    table = spark.createDataFrame(rows, "source string, store string, path string, date string, time_ms long")
    got = {r.selector: r.path for r in selectors.sessions_by_id(table, ["ab12", "cd34", "EF56", "gh78", "none", ""]).collect()}
    assert got == {"ab12": rows[0][2], "cd34": rows[2][2], "EF56": rows[4][2], "gh78": rows[6][2], "none": None}
    parts = {r.selector: r.path for r in selectors.session_parts(table, "ab12/subagents", ["H", "q"]).collect()}
    assert parts == {"H": rows[1][2], "q": None}
    assert selectors.sessions_by_id(table, []).count() == 0


def _leaves(value):
    if isinstance(value, dict):
        return [x for v in value.values() for x in _leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    if value is None or value == "":
        return []
    return [json.dumps(value) if isinstance(value, (bool, int, float)) else value]


def _value(rng, depth=0):
    pick = rng.randrange(8 if depth < 5 else 6)
    if pick < 3:
        return "".join(rng.choice(['"', "\\", "\n", "a", "é", "\U0001f600", ":", ",", "{", "]", " ", "/", "true", "1"]) for _ in range(rng.randrange(8)))
    if pick < 6:
        return rng.choice([None, True, False, rng.randrange(-99, 99), rng.randrange(99) / 8])
    if pick == 6:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f'k"{k}:': _value(rng, depth + 1) for k in range(rng.randrange(4))}


def test_leaves_of_any_json(spark):
    rng = random.Random(5)
    values = [_value(rng) for _ in range(400)] + ["\\\"" * 100_000, {"a": ["x" * 300_000]}, [[[[[[[[[["deep"]]]]]]]]]]]
    rows = [(k, json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for k, v in enumerate(values)]
    got = {r.k: r.l for r in spark.createDataFrame(rows, "k int, j string").select("k", calls.leaves(F.col("j")).alias("l")).collect()}
    for k, v in enumerate(values):
        assert got[k] == _leaves(v), rows[k]


def test_text_of_calls(spark):
    rows = [
        ("s", 0, "tool_call", "Bash", '{"command": "echo \\"hi\\" > C:\\\\tmp", "timeout": 5, "x": null, "y": ""}'),
        ("s", 1, "tool_result", "Bash", "error: no such file"),
        ("s", 2, "tool_call", None, "not { json"),
        ("s", 3, "tool_result", None, None),
        ("t", 0, "tool_call", "Fetch", None),
        ("t", 1, "other", "x", "say hi"),
    ]
    events = spark.createDataFrame(rows, "path string, idx long, kind string, tool string, input string")
    got = {(r.path, r.idx): r.text for r in calls.texts(events).collect()}
    assert got == {("s", 0): 'Bash: echo "hi" > C:\\tmp 5', ("s", 1): "Bash result: error: no such file", ("s", 2): "tool: not { json", ("s", 3): "tool result: ", ("t", 0): "Fetch:"}
    assert [(r.path, r["count"], r.idx) for r in calls.search(events, 'echo "hi"').collect()] == [("s", 1, 0)]
    assert [(r.path, r["count"], r.idx) for r in calls.search(events, "c:\\tmp").collect()] == [("s", 1, 0)]
    assert [(r.path, r.idx) for r in calls.search(events, "bash result").collect()] == [("s", 1)]
    assert [(r.path, r["count"]) for r in calls.search(events, "tool").collect()] == [("s", 2)], "what has no name is a tool"
    assert calls.search(events, "command").count() == 0, "keys are not searched"
    assert calls.search(events.limit(0), "x").count() == 0


def test_orders(spark):
    words = ["b", "A", "a", "_z", "é", "e", "Z1", "-q", "1", "É", "z", "", "\uffee", "\U0001f600"]
    table = spark.createDataFrame([(w,) for w in words], "w string")
    by = lambda key: [r.w for r in table.orderBy(key(F.col("w"))).collect()]
    assert [w for w in by(order.by_locale) if w not in words[-2:]] == ["", "_z", "-q", "1", "a", "A", "b", "e", "é", "É", "z", "Z1"]
    assert by(order.by_units) == sorted(words, key=lambda w: w.encode("utf-16-be"))
    assert by(order.by_units)[-2:] == ["\U0001f600", "\uffee"], "two units come before the last of one"


def test_equal_notes_stand_in_collated_order(spark):
    rows = [(p, "p", "md", "word") for p in ("B.md", "a.md", "é.md", "_x.md", "A.md")]
    found = notes.keyword(spark.createDataFrame(rows, "path string, project string, type string, text string"), "word")
    assert [r.path for r in found.orderBy("rank").collect()] == ["_x.md", "a.md", "A.md", "B.md", "é.md"]
