"""The queue of chunks that wait for vectors."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle

from threadlake.operators import notes
from threadlake.streaming import embed_queue
from threadlake.streaming.embed_queue import EmbedError, EmbedQueue, Entry, step

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import tests


class Provider:
    """Keeps its batches in a folder, as tasks and driver each have a copy of it."""

    def __init__(self, folder):
        self.folder = str(folder)
        os.makedirs(self.folder, exist_ok=True)

    def _note(self, word):
        with open(f"{self.folder}/log", "a") as f:
            f.write(word + "\n")

    def log(self):
        return open(f"{self.folder}/log").read().split() if os.path.exists(f"{self.folder}/log") else []

    def set(self, **how):
        with open(f"{self.folder}/how", "w") as f:
            json.dump(how, f)

    def how(self, name):
        return json.load(open(f"{self.folder}/how")).get(name) if os.path.exists(f"{self.folder}/how") else None

    @staticmethod
    def vector(text):
        return None if "bad" in text else [float(len(text)), 1.0]

    def submit(self, texts, key):
        if (kind := self.how("submit")) is not None:
            raise EmbedError("no", retryable=kind == "busy")
        self._note("submit")
        with open(f"{self.folder}/{key}", "w") as f:
            json.dump(texts, f)
        return key

    def poll(self, batch):
        if self.how("poll") == "running":
            return None
        if self.how("poll") == "gone":
            raise EmbedError("404", retryable=False)
        return [self.vector(t) for t in json.load(open(f"{self.folder}/{batch}"))]

    def embed(self, texts):
        if self.how("embed") == "busy":
            raise EmbedError("429")
        self._note("embed")
        return [self.vector(t) for t in texts]

    def cancel(self, batch):
        self._note("cancel")


def _chunks(spark, rows):
    return spark.createDataFrame([(*r, False)[:4] for r in rows], "id string, title string, text string, withheld boolean")


def _status(queue):
    return {r.id: r.status for r in queue.states().collect()}


@pytest.fixture
def made(spark, tmp_path):
    spark.sparkContext  # the session stands before the provider is sent to tasks
    provider = Provider(tmp_path / "provider")
    return provider, EmbedQueue(spark, f"file://{tmp_path}/queue", provider)


def test_submit_collect_and_change(spark, made):
    provider, queue = made
    assert queue.states().count() == 0
    queue.put(_chunks(spark, [("a", "t", "one"), ("b", "t", "two two"), ("c", None, None), ("s", "t", "key", True), (None, "t", "x")]))
    assert queue.advance()
    assert _status(queue) == {"a": "submitted", "b": "submitted", "c": "submitted"} and "embed" not in provider.log()
    (counts,) = notes.queue_counts(queue.states()).collect()
    assert counts.submitted == 3 and counts.batches >= 1
    sent = len(provider.log())
    queue.put(_chunks(spark, [("a", "t", "one"), ("b", "t", "another")]))  # a as it was, b while its batch is out
    assert queue.advance()
    rows = {r.id: r for r in queue.states().collect()}
    assert rows["a"].status == rows["c"].status == "done" and list(rows["a"].vec) == [5.0, 1.0] and list(rows["c"].vec) == [1.0, 1.0]
    assert rows["b"].status == "submitted" and len(provider.log()) == sent + 1, "the answer for the old text is left"
    queue.drop(spark.createDataFrame([("c",)], "id string"))
    assert queue.advance()
    rows = {r.id: r for r in queue.states().collect()}
    assert set(rows) == {"a", "b"} and list(rows["b"].vec) == [9.0, 1.0]
    queue.put(_chunks(spark, [("a", "t", "one")]), model="other", dims=2)
    assert queue.advance() and _status(queue)["a"] == "submitted", "another model makes it other content"


def test_loss_refusal_and_requeue(spark, made):
    provider, queue = made
    queue.put(_chunks(spark, [("a", "t", "one"), ("x", "t", "bad")]))
    queue.advance()
    queue.advance()  # the batch answers a, not x; x is embedded at once
    queue.advance()
    assert _status(queue) == {"a": "done", "x": "failed"} and "embed" in provider.log()
    queue.requeue()
    provider.set(poll="gone")
    queue.advance()
    assert _status(queue)["x"] == "submitted"
    queue.advance()
    queue.advance()
    assert _status(queue) == {"a": "done", "x": "failed"}, "a batch that is gone is not waited for"
    provider.set(submit="never")
    queue.put(_chunks(spark, [("n", "t", "new")]))
    for _ in range(3):
        queue.advance()
    assert _status(queue)["n"] == "done", "where there are no batches, texts are embedded at once"


def test_timers(spark, tmp_path):
    provider = Provider(tmp_path / "provider")
    queue = EmbedQueue(spark, f"file://{tmp_path}/queue", provider, patience=1500, retry=500)
    provider.set(submit="busy")
    queue.put(_chunks(spark, [("a", "t", "one")]))
    queue.advance()
    assert _status(queue) == {"a": "pending"} and provider.log() == []
    provider.set(poll="running")
    time.sleep(0.6)
    queue.advance()
    assert provider.log() == ["submit"], "sent again when its timer ran out"
    time.sleep(1.6)
    queue.advance()
    queue.advance()
    assert sorted(provider.log()) == ["cancel", "embed", "submit"] and _status(queue) == {"a": "done"}


def test_lease(spark, tmp_path):
    now = [1_000_000]
    place = f"file://{tmp_path}/queue"
    one, two = (EmbedQueue(spark, place, None, clock=lambda: now[0]) for _ in range(2))
    assert one.take_lease() and one.take_lease() and not two.take_lease() and not two.advance()
    now[0] += embed_queue.LEASE_MS
    assert not two.take_lease() and one.take_lease(renew=True), "held to its last moment, then renewed"
    now[0] += embed_queue.LEASE_MS + 1
    assert not one.take_lease(renew=True), "what has lapsed is not renewed"
    assert two.take_lease() and not one.take_lease()
    one.release_lease()
    assert not one.take_lease(), "only the holder gives it back"
    two.release_lease()
    assert one.take_lease()


def _event(kind, at=0, sha="s", **more):
    return {"kind": kind, "at": at, "sha": sha, "title": "t", "text": "x", "batch_id": None, "pos": None, "vec": None} | more


def test_steps_by_a_clock():
    day = embed_queue.PATIENCE_MS
    entry, out = step(None, [_event("chunk")], now=0)
    assert entry.status == "pending" and [o["action"] for o in out] == ["submit", "state"]
    entry, out = step(entry, [_event("submitted", batch_id="b", pos=4)], now=10)
    assert (entry.status, entry.pos, entry.due) == ("submitted", 4, 10 + day) and [o["action"] for o in out] == ["state"]
    assert step(entry, [], now=9 + day) == (entry, [])
    late, out = step(entry, [], now=10 + day)
    assert late.status == "retry" and [o["action"] for o in out] == ["cancel", "embed", "state"] and out[0]["batch_id"] == "b"
    done, out = step(entry, [_event("result", batch_id="b", pos=4, vec=[1.0])], now=10 + day)
    assert done.status == "done" and done.text is None and [o["action"] for o in out] == ["state"], "an answer in the last moment counts"
    assert step(entry, [_event("result", batch_id="old", pos=4, vec=[1.0])], now=11) == (entry, []), "of a batch that is not this one's"
    assert step(entry, [_event("result", sha="other", batch_id="b", pos=4, vec=[1.0])], now=11) == (entry, []), "for other content"
    assert step(late, [_event("result", batch_id="b", pos=4, vec=[1.0])], now=11 + day)[0] == late
    assert step(late, [_event("result", vec=[1.0])], now=11 + day)[0].status == "done"
    assert step(entry, [_event("gone")], now=11)[0] is None and step(None, [_event("gone")], now=11) == (None, [])
    assert step(entry, [_event("chunk")], now=11) == (entry, []), "known content is no work"
    changed, out = step(entry, [_event("chunk", sha="new", at=5), _event("lost", batch_id="b", at=6)], now=11)
    assert changed == Entry("new", "pending", "t", "x", due=11 + embed_queue.RETRY_MS) and out[0]["sha"] == "new"


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(embed_queue, "BATCH_CHUNKS", 3)
    monkeypatch.setattr(embed_queue, "BATCH_BYTES", 10)
    rows = [{"title": "", "text": "x" * n} for n in (1, 1, 1, 1, 9, 30, 2)]
    assert [[len(r["text"]) for r in part] for part in embed_queue.batches(rows)] == [[1, 1, 1], [1, 9], [30], [2]]
