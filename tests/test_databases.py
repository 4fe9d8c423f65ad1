import json
import sqlite3

import zstandard
from pyspark.sql import functions as F

from threadlake.functions import paths
from threadlake.sources import databases, discovery


def _db(path, script, rows):
    con = sqlite3.connect(path)
    con.executescript(script)
    for sql, values in rows:
        con.execute(sql, values)
    con.commit()
    con.close()
    return str(path)


def test_opencode_hybrid(spark, tmp_path):
    db = _db(
        tmp_path / "o.db",
        "create table message (id text primary key, session_id text, time_created int, data text); create table part (id text primary key, message_id text, session_id text, time_created int, data text);"
        "create table session_message (id text primary key, session_id text, type text, seq int, time_created int, data text);",
        [
            ("insert into message values ('m1','old',1,?)", (json.dumps({"role": "user"}),)),
            ("insert into part values ('p1','m1','old',1,?)", (json.dumps({"type": "text", "text": "legacy"}),)),
            ("insert into message values ('m2','new',1,?)", (json.dumps({"role": "user"}),)),
            ("insert into part values ('p2','m2','new',1,?)", (json.dumps({"type": "text", "text": "moved"}),)),
            ("insert into session_message values ('s1','new','user',1,5,?)", (json.dumps({"text": "hi"}),)),
            ("insert into session_message values ('s2','new','assistant',2,6,?)", (json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}]}),)),
        ],
    )
    got = sorted((r.path.rsplit("#")[1], r.seq, r.role, r.text) for r in databases.opencode(spark, [db]).collect())
    assert got == [("new", 1, "user", "hi"), ("new", 2, "assistant", "a b"), ("old", 1, "user", "legacy")]
    assert databases.session_list(databases.opencode(spark, [db])).count() == 2


def test_openclaw_and_hermes(spark, tmp_path):
    event = json.dumps({"message": {"role": "assistant", "content": [{"type": "text", "text": "packed"}]}})
    frame = zstandard.ZstdCompressor().compress(event.encode())
    claw = _db(
        tmp_path / "c.db",
        "create table transcript_events (session_id text, seq int, event_json text, created_at int, event_zstd blob);",
        [
            ("insert into transcript_events values ('s',2,null,7,?)", (frame,)),
            ("insert into transcript_events values ('s',1,?,6,null)", (json.dumps({"message": {"role": "user", "content": "plain"}}),)),
            ("insert into transcript_events values ('s',3,null,8,?)", (frame[:6],)),
        ],
    )
    assert [(r.seq, r.text) for r in databases.openclaw(spark, [claw]).orderBy("seq").collect()] == [(1, "plain"), (2, "packed")]
    herm = _db(tmp_path / "h.db", "create table messages (id integer primary key, session_id text, role text, content text, timestamp real, active int);", [("insert into messages values (1,'s','user','x',1.5,1)", ()), ("insert into messages values (2,'s','user','gone',2,0)", ())])
    assert [(r.text, r.time_ms) for r in databases.hermes(spark, [herm]).collect()] == [("x", 1500)]


def test_discovery(tmp_path):
    (tmp_path / ".claude/projects").mkdir(parents=True)
    (tmp_path / ".omp/profiles/a/agent/sessions").mkdir(parents=True)
    found = discovery.discover({}, str(tmp_path))
    assert [s.source for s in found] == ["claude", "omp"]
    assert discovery.discover({}, str(tmp_path), "codex") == []
    stores = {(s.source, s.path) for s in discovery.roots({"CODEX_HOME": "/c", "OPENCODE_DB": "/d/x.db", "PI_CODING_AGENT_DIR": "~/p"}, "/h")}
    assert ("codex", "/c/sessions") in stores and ("opencode", "/d/x.db") in stores and ("pi", "/h/p/sessions") in stores
    assert not [s for s in discovery.roots({"OPENCODE_DB": ":memory:"}, "/h") if s.source == "opencode"]


def test_paths(spark):
    uid = "0" * 8 + "-1111-2222-3333-" + "4" * 12
    rows = [
        ("claude", f"/h/.claude/projects/-w-x/{uid}.jsonl", f"claude --resume {uid}", "unknown", "claude"),
        ("codex", f"/c/sessions/2024/05/06/rollout-2024-05-06T07-{uid}.jsonl", f"codex resume {uid}", "2024-05-06", "codex"),
        ("opencode", "opencode:///d/o.db#ses_ab1", "opencode2 -s ses_ab1", "unknown", "opencode"),
        ("claude", "/x/sessions/2023/01/02/short.jsonl", None, "2023-01-02", None),
    ]
    df = spark.createDataFrame(rows, "source string, path string, command string, date string, found string")
    for r in df.withColumns({"c": paths.resume_command(F.col("source"), F.col("path")), "d": paths.date_of(F.col("path")), "s": paths.source_of(F.col("path"))}).collect():
        assert (r.c, r.d, r.s) == (r.command, r.date, r.found)
    one = spark.createDataFrame([("/h/a",), ("/h",), ("/hx",)], "path string").select(paths.compact_home(F.col("path"), "/h"), paths.under(F.col("path"), "/h")).collect()
    assert [tuple(r) for r in one] == [("~/a", True), ("~", True), ("/hx", False)]
