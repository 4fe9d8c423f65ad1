"""The queue of chunks that wait for vectors, as a stateful stream.

What happens to a chunk is an event: its content came or went, a batch took it,
an answer came, a batch was lost. A stream reads the events, keeps one small
state a chunk (its text only until it has a vector) and sends on what to do:
submit it with a batch, embed it now, cancel a batch. What sending brings is
written as events again. Timers bring back what stays out too long: a chunk that
no batch has taken after ``RETRY_MS`` is sent again, one whose batch has not
answered after ``PATIENCE_MS`` is embedded at once.

A micro-batch writes under its own number, so one that runs again replaces
itself; should a batch be submitted twice, answers of the one that the state does
not know are left. An answer counts only for the content that it was asked for.
One process at a time moves the queue, by a lease that lapses.

The embedder is passed in and sent to tasks: ``submit(texts, key) -> batch id``
(the same key for the same chunks, should a task run again), ``poll(batch id)``
-> None while it runs, else a vector or None per text, ``embed(texts)`` -> a
vector or None per text, ``cancel(batch id)``; each may raise ``EmbedError``.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlake.streaming.versions import names

LEASE_MS = 30 * 60 * 1000
PATIENCE_MS = 24 * 3600 * 1000
RETRY_MS = 10 * 60 * 1000
BATCH_CHUNKS, BATCH_BYTES = 1000, 4 << 20

EVENTS = "id string, kind string, at long, sha string, title string, text string, batch_id string, pos int, vec array<float>"
STATE = "sha string, status string, title string, text string, batch_id string, pos int, due long"
ACTIONS = "id string, action string, sha string, status string, title string, text string, batch_id string, pos int, vec array<float>"
EVENT_NAMES, ACTION_NAMES = ([c.split()[0] for c in s.split(", ")] for s in (EVENTS, ACTIONS))
#: Of events of one moment, the order in which they can have come about.
ORDER = ("chunk", "gone", "requeue", "submitted", "lost", "failed", "result")


class EmbedError(Exception):
    """``retryable``: the same call may succeed later."""

    def __init__(self, message: str, retryable: bool = True):
        super().__init__(message, retryable)
        self.retryable = retryable


@dataclass(frozen=True)
class Entry:
    sha: str
    status: str
    title: str | None = None
    text: str | None = None
    batch_id: str | None = None
    pos: int | None = None
    due: int | None = None


def step(entry: Entry | None, events: Iterable[dict], now: int, patience: int = PATIENCE_MS, retry: int = RETRY_MS) -> tuple[Entry | None, list[dict]]:
    """The chunk's next state and what to do, after its events or its timer."""
    before, todo, vec = entry, None, None
    cancelled = []

    def to(status: str, **more) -> Entry:
        wait = {"pending": retry, "retry": retry, "submitted": patience}.get(status)
        return replace(entry, status=status, due=None if wait is None else now + wait, **({"batch_id": None, "pos": None} | more))

    for e in sorted(events, key=lambda e: (e["at"], ORDER.index(e["kind"]))):
        kind = e["kind"]
        if kind == "chunk":
            if entry is None or entry.sha != e["sha"]:
                entry = Entry(e["sha"], "pending", e["title"], e["text"])
                entry, todo = to("pending"), "submit"
        elif kind == "gone":
            entry, todo = None, None
        elif entry is None or (kind != "requeue" and entry.sha != e["sha"]):
            continue  # about what is no longer there
        elif kind == "requeue":
            if entry.status == "failed":
                entry, todo = to("pending"), "submit"
        elif kind == "submitted":
            if entry.status == "pending":
                entry, todo = to("submitted", batch_id=e["batch_id"], pos=e["pos"]), None
        elif (entry.status == "submitted" and entry.batch_id == e["batch_id"]) or (entry.status == "retry" and e["batch_id"] is None):
            if kind == "lost":
                entry, todo = to("retry"), "embed"
            elif kind == "failed":
                entry, todo = to("failed"), None
            elif entry.pos == e["pos"]:
                # texts of what is done are not kept; a failed chunk may be asked for again
                entry, todo, vec = to("done", title=None, text=None), None, e["vec"]
    # what came in time counts, though its timer has run out by now
    if entry is not None and entry.due is not None and entry.due <= now:
        if entry.status == "submitted":
            cancelled.append(entry.batch_id)
        entry = to("pending" if entry.status == "pending" else "retry")
        todo = "submit" if entry.status == "pending" else "embed"
    out = [{"action": "cancel", "batch_id": b} for b in cancelled]
    if entry is not None and todo:
        out.append({"action": todo, **asdict(entry)})
    if entry is None and before is not None:
        out.append({"action": "state", "sha": before.sha, "status": "gone"})
    elif entry is not None and (before is None or (before.sha, before.status, before.batch_id) != (entry.sha, entry.status, entry.batch_id)):
        out.append({"action": "state", "sha": entry.sha, "status": entry.status, "batch_id": entry.batch_id, "pos": entry.pos, "vec": vec})
    return entry, out


def _rows(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows with None for what is missing."""
    for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
        yield row | {"pos": None if row.get("pos") is None else int(row["pos"])}


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns).astype({"pos": "Int32"})


def _stepper(patience: int, retry: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = Entry(*state.get) if state.exists else None
        # the events of one chunk since the last micro-batch: a few rows
        events = [] if state.hasTimedOut else [r for f in frames for r in _rows(f)]
        now = state.getCurrentProcessingTimeMs()
        entry, out = step(entry, events, now, patience, retry)
        if entry is not None:
            state.update(tuple(asdict(entry).values()))
            if entry.due is not None:
                state.setTimeoutDuration(max(1, entry.due - now))
        elif state.exists:
            state.remove()
        yield _frame([{"id": key[0], **o} for o in out], ACTION_NAMES)

    return run


def batches(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of chunks within the limits of a batch; one chunk at least."""
    held, size = [], 0
    for r in rows:
        n = len((r["title"] or "").encode()) + len((r["text"] or "").encode())
        if held and (len(held) == BATCH_CHUNKS or size + n > BATCH_BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held


def _sender(embedder, clock: Callable[[], int]):
    def event(row: dict, kind: str, **more) -> dict:
        return {"id": row.get("id"), "kind": kind, "at": clock(), "sha": row.get("sha")} | more

    def embed(part: list[dict]) -> list[dict]:
        try:
            vectors = embedder.embed([f"{r['title']}\n{r['text']}" for r in part])
        except EmbedError as e:
            # what may succeed later comes back by its timer
            return [] if e.retryable else [event(r, "failed") for r in part]
        return [event(r, "failed") if v is None else event(r, "result", vec=v) for r, v in zip(part, vectors)]

    def submit(part: list[dict]) -> list[dict]:
        key = hashlib.sha256("\n".join(f"{r['id']} {r['sha']}" for r in part).encode()).hexdigest()
        try:
            batch = embedder.submit([f"{r['title']}\n{r['text']}" for r in part], key)
        except EmbedError as e:
            if e.retryable:
                return []
            # no batches here: mark as taken by none, then answer at once
            return [x for r in part for x in (event(r, "submitted", batch_id=key), event(r, "lost", batch_id=key))]
        return [event(r, "submitted", batch_id=batch, pos=k) for k, r in enumerate(part)]

    def cancel(part: list[dict]) -> list[dict]:
        for b in {r["batch_id"] for r in part}:
            try:
                embedder.cancel(b)
            except EmbedError:
                pass  # it is no longer waited for, whether it runs on or not
        return [event({}, "closed", batch_id=r["batch_id"]) for r in part]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = list(_rows(frame))
            for action, act in (("cancel", cancel), ("embed", embed), ("submit", submit)):
                for part in batches([r for r in rows if r["action"] == action]):
                    yield _frame(act(part), EVENT_NAMES)

    return run


def wall_ms() -> int:
    return time.time_ns() // 1_000_000


class EmbedQueue:
    """A queue in a folder that all executors share."""

    def __init__(self, spark: SparkSession, place: str, embedder, clock: Callable[[], int] = wall_ms, patience: int = PATIENCE_MS, retry: int = RETRY_MS):
        self.spark, self.place, self.embedder, self.clock = spark, place, embedder, clock
        self.patience, self.retry = patience, retry
        self.owner = uuid.uuid4().hex

    def _put(self, events: DataFrame, folder: str | None = None) -> None:
        missing = [F.lit(None).alias(c) for c in EVENT_NAMES if c not in events.columns]
        rows = events.select("*", *missing).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EVENTS.split(", ")])
        rows.write.mode("overwrite").parquet(f"{self.place}/events/{folder or uuid.uuid4().hex}")

    def _events(self) -> DataFrame:
        there = names(self.spark, f"{self.place}/events")
        read = self.spark.read.schema(EVENTS).option("recursiveFileLookup", "true")
        return read.parquet(f"{self.place}/events") if there else self.spark.createDataFrame([], EVENTS)

    def put(self, chunks: DataFrame, model: str = "", dims: int = 0) -> None:
        """Chunks (id, title, text, withheld) that are new or changed; the rest
        are no work. Another model or size is other content. Withheld chunks
        never enter, and leave should they be in."""
        sha = F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(dims)), "title", "text"), 256)
        kind = F.when(F.coalesce("withheld", F.lit(False)), "gone").otherwise("chunk")
        shown = lambda c: F.when(kind == "chunk", F.coalesce(c, F.lit("")))
        self._put(chunks.filter("id IS NOT NULL").select("id", kind.alias("kind"), F.lit(self.clock()).alias("at"), sha.alias("sha"), shown("title").alias("title"), shown("text").alias("text")))

    def drop(self, ids: DataFrame) -> None:
        self._put(ids.filter("id IS NOT NULL").select("id", F.lit("gone").alias("kind"), F.lit(self.clock()).alias("at")))

    def requeue(self) -> None:
        """Give chunks that the provider turned down another try."""
        self._put(self.states().filter("status = 'failed'").select("id", F.lit("requeue").alias("kind"), F.lit(self.clock()).alias("at")))

    def poll(self) -> None:
        """Ask after every batch that is out."""
        events, embedder = self._events(), self.embedder
        taken = events.filter("kind = 'submitted' AND pos IS NOT NULL").select("id", "sha", "batch_id", "pos")
        out = taken.select("batch_id").distinct().join(events.filter("kind = 'closed'").select("batch_id"), "batch_id", "left_anti")

        def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for batch in frame["batch_id"]:
                    try:
                        answers = embedder.poll(batch)
                    except EmbedError as e:
                        answers = None if e.retryable else []
                    if answers is not None:
                        rows = [(batch, -1, None), *((batch, k, v) for k, v in enumerate(answers))]
                        yield pd.DataFrame(rows, columns=["batch_id", "pos", "vec"]).astype({"pos": "int32"})

        name = uuid.uuid4().hex
        asked = f"{self.place}/answers/{name}"
        out.mapInPandas(ask, "batch_id string, pos int, vec array<float>").write.parquet(asked)
        answers = self.spark.read.parquet(asked)
        closed = answers.filter("pos = -1").select("batch_id")
        found = taken.join(closed, "batch_id", "left_semi").join(answers, ["batch_id", "pos"], "left")
        kind = F.when(F.col("vec").isNull(), "lost").otherwise("result")
        ended = closed.select(F.lit("closed").alias("kind"), "batch_id")
        self._put(found.withColumn("kind", kind).unionByName(ended, allowMissingColumns=True).withColumn("at", F.lit(self.clock())), f"polled-{name}")

    def _run(self) -> None:
        stream = self.spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.place}/events")
        mine = stream.filter(F.col("kind").isin(*ORDER) & F.col("id").isNotNull())
        actions = mine.groupBy("id").applyInPandasWithState(_stepper(self.patience, self.retry), ACTIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

        def act(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{self.place}/actions/batch={number}")
            todo = self.spark.read.schema(ACTIONS).parquet(f"{self.place}/actions/batch={number}").filter("action <> 'state'")
            self._put(todo.mapInPandas(_sender(self.embedder, self.clock), EVENTS), f"sent-{number}")

        setting = "spark.sql.streaming.noDataMicroBatches.enabled"
        had = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")  # timers would ask for empty micro-batches without end
        try:
            query = actions.writeStream.outputMode("append").foreachBatch(act).option("checkpointLocation", f"{self.place}/checkpoint").trigger(availableNow=True).start()
        finally:
            self.spark.conf.set(setting, had)
        query.awaitTermination()

    def advance(self) -> bool:
        """Ask after batches, take in what happened, run due timers, send. False
        while another process is at it."""
        if not self.take_lease():
            return False
        try:
            self.poll()
            self._put(self.spark.range(1).select(F.lit("tick").alias("kind"), F.lit(self.clock()).alias("at")))
            for _ in range(2):  # the second takes in what sending brought
                if not self.take_lease(renew=True):
                    return False
                self._run()
        finally:
            self.release_lease()
        return True

    def states(self) -> DataFrame:
        """id, sha, status, batch_id, pos, vec of every chunk as it now stands."""
        if not names(self.spark, f"{self.place}/actions"):
            return self.spark.createDataFrame([], ACTIONS).select("id", "sha", "status", "batch_id", "pos", "vec")
        rows = self.spark.read.schema(f"{ACTIONS}, batch long").parquet(f"{self.place}/actions").filter("action = 'state'")
        latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch")))
        return rows.withColumn("latest", latest).filter("latest = 1 AND status <> 'gone'").select("id", "sha", "status", "batch_id", "pos", "vec")

    # --- lease: a file that only one process can create --------------------

    def _lease(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.place}/lease")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _holder(self) -> tuple[int, str] | None:
        path, store = self._lease()
        if not store.exists(path):
            return None
        source = store.open(path)
        try:
            until, _, owner = source.readUTF().partition(":")
        finally:
            source.close()
        return int(until), owner

    def take_lease(self, renew: bool = False) -> bool:
        """``renew``: only a lease that is still held and has not lapsed."""
        path, store = self._lease()
        holder, now = self._holder(), self.clock()
        if holder is not None and holder[1] != self.owner and (renew or holder[0] >= now):
            return False
        if renew and (holder is None or holder[0] < now):
            return False
        if holder is not None and holder[1] != self.owner:
            # of several that find it lapsed, one can move it away
            aside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.place}/lapsed-{uuid.uuid4().hex}")
            if not store.rename(path, aside):
                return False
            store.delete(aside, False)
        try:
            sink = store.create(path, holder is not None and holder[1] == self.owner)
        except Exception:  # created by another in between
            if (holder := self._holder()) is not None and holder[1] != self.owner:
                return False
            raise
        sink.writeUTF(f"{now + LEASE_MS}:{self.owner}")
        sink.close()
        return True

    def release_lease(self) -> None:
        path, store = self._lease()
        if (holder := self._holder()) is not None and holder[1] == self.owner:
            store.delete(path, False)
