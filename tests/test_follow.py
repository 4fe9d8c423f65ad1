"""Following a database that changes."""

import json
import sqlite3

from threadlake.sources import sqlite_changes
from threadlake.streaming import follow


def _do(path, *steps):
    con = sqlite3.connect(path)
    for sql, *values in steps:
        con.execute(sql, values)
    con.commit()
    con.close()


def _text(text, kind="text"):
    return json.dumps({"type": kind, "text": text})


PART = "insert into part values (?, ?, ?, ?, ?, ?)"
MADE = [
    ("create table message (id text primary key, session_id text, time_created int, data text)",),
    ("create table part (id text primary key, message_id text, session_id text, time_created int, time_updated int, data text)",),
]
NEWER = ("create table session_message (id text primary key, session_id text, type text, time_created int, time_updated int, data text)",)


def _said(spark, table):
    return sorted((r.path.rsplit("#")[1], r.seq, r.role, r.text) for r in follow.messages(spark, table).collect())


def test_only_what_changed_is_read(spark, tmp_path):
    db, table, mark = str(tmp_path / "o.db"), str(tmp_path / "table"), str(tmp_path / "mark")
    assert follow.follow(spark, [db], table, mark) == {"legacy": 0, "current": 0} and _said(spark, table) == []
    user = json.dumps({"role": "user"})
    _do(db, *MADE, ("insert into message values ('m1', 's1', 1, ?)", user), ("insert into message values ('m2', 's2', 1, ?)", user))
    _do(db, (PART, "p1", "m1", "s1", 1, 1, _text("first")), (PART, "p2", "m1", "s1", 2, 2, _text("hidden", "reasoning")), (PART, "p3", "m2", "s2", 3, 3, _text("other")))
    assert follow.follow(spark, [db], table, mark) == {"legacy": 3, "current": 0}
    assert _said(spark, table) == [("s1", 1, "user", "first"), ("s2", 1, "user", "other")]
    # a part is touched, one comes in at the same time, one is no text any more
    _do(db, ("update part set time_updated = 4, data = ? where id = 'p1'", _text("first, longer")), (PART, "p4", "m1", "s1", 4, 4, _text("second")), ("update part set time_updated = 5, data = ? where id = 'p3'", _text("other", "tool")))
    assert follow.follow(spark, [db], table, mark) == {"legacy": 3, "current": 0}
    assert _said(spark, table) == [("s1", 1, "user", "first, longer"), ("s1", 2, "user", "second")]
    assert follow.follow(spark, [db], table, mark) == {"legacy": 0, "current": 0}
    # the session moves to the newer layout
    _do(db, NEWER, ("insert into session_message values ('x1', 's1', 'user', 1, 9, ?)", json.dumps({"text": "moved"})))
    assert follow.follow(spark, [db], table, mark) == {"legacy": 0, "current": 1}
    assert _said(spark, table) == [("s1", 1, "user", "moved")]


def test_runs_cover_every_change_once(tmp_path):
    db = str(tmp_path / "o.db")
    _do(db, *MADE)
    _do(db, *[(PART, f"p{k:02d}", "m", "s", k, k // 4, "{}") for k in range(23)])
    reader = sqlite_changes.ChangesReader({"path": f"{db},{tmp_path}/missing.db", "table": "part", "rowsPerPartition": "5"})
    end = reader.latestOffset()
    assert end == {db: {"time": 5, "id": "p22"}}
    parts = reader.partitions({}, end)
    assert len(parts) == 5 and [r[2] for p in parts for r in reader.read(p)] == [f"p{k:02d}" for k in range(23)]
    later = reader.partitions({db: {"time": 4, "id": "p17"}}, end)
    assert [r[2] for p in later for r in reader.read(p)] == ["p18", "p19", "p20", "p21", "p22"]
    assert reader.partitions(end, end) == []
