"""Web archives, index first.

Each task writes archives of up to ``ARCHIVE_BYTES``, made of gzip members, a
member per record after one that describes the archive, and returns an index row
per record: file, offset, length, URL and digest. The rows are stored as the
index table before anything reads the archives. Reading takes selected index
rows, deals them out in ranges of file and offset by the bytes they ask for
(``TASK_BYTES`` a task), merges ranges whose gap is small into one read, and
cuts the records out of it.

Of records with equal payloads of at least ``dedup_bytes`` bytes the one with
the smallest id carries the payload (``response``); the others point at it
(``revisit``) and carry none. A record's own id is a UUID of its archive and
offset, so repeated pages have ids of their own; the page id is a header.

Edge cases: a null payload is empty; a null url gives an empty target URI, and
white space and control characters in one are percent-coded; a null id is
written as an empty id and is never the smallest of its payload
unless all ids are null (then every such record is a response); repeated rows
of the smallest id are all responses; an empty table writes no archive; extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import shared_files
from threadlake.session import bound_batches, materialize, shared_path

DEDUP_BYTES = 100
MERGE_GAP = 64 << 10
MAX_READ = 8 << 20
TASK_BYTES = 4 << 20
ARCHIVE_BYTES = 1 << 30
RECORD_DATE = "2026-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of each page.

    First-holders are found over (id, digest) rows, summed before the shuffle;
    only digests seen twice are joined back. Payloads too short to share get keys
    of their own there, so that they are spread.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    holders = (
        base.filter(F.octet_length("payload") >= dedup_bytes)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("key"), F.col("first.page_id").alias("holder"), F.col("first.url").alias("refers_url"))
    )
    key = F.when(F.octet_length("payload") >= dedup_bytes, F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    refers = F.when(F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))
    return (
        base.withColumn("key", key)
        .join(holders, "key", "left")
        .withColumn("refers_to", refers)
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .select("page_id", "url", "payload", "digest", "record_type", "refers_to", "refers_url")
    )


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "")


def _record(record_id: uuid.UUID, page_id, url, payload: bytes, digest: str, kind: str, refers_to, refers_url) -> bytes:
    body = b"" if kind == "revisit" else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode() + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
        head += [f"WARC-Refers-To-Date: {RECORD_DATE}", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive_head(name: str) -> bytes:
    block = b"software: threadlake\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {RECORD_DATE}"]
    head += [f"WARC-Filename: {name.rpartition('/')[2]}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records; returns the stored index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        while first is not None:
            name = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
            at, found = 0, []
            with shared_files.create(name) as out:
                head = gzip.compress(_archive_head(name), 4, mtime=0)
                out.write(head)
                at += len(head)
                while first is not None and at < archive_bytes:
                    page_id, url, payload, digest, kind, refers_to, refers_url = first
                    record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")
                    member = gzip.compress(_record(record_id, page_id, url, payload, digest, kind, refers_to, refers_url), 4, mtime=0)
                    out.write(member)
                    found.append((name, at, len(member), url, digest, page_id, kind, refers_to))
                    at += len(member)
                    first = next(rows, None)
                    if len(found) >= 4096:
                        # rows of an archive that is never finished are lost with their task
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), _INDEX_TYPES)], _INDEX_NAMES)
                        found = []
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), _INDEX_TYPES)], _INDEX_NAMES)

    bound_batches(rows.sparkSession)
    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


_INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]
_INDEX_TYPES = [pa.string() if part.endswith("string") else pa.int64() for part in INDEX.split(", ")]


def parse_record(member: bytes) -> dict:
    """Headers of interest and payload of one record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {
        "page_id": number("Page-ID"),
        "url": fields.get("WARC-Target-URI", ""),
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_id": fields["WARC-Record-ID"],
        "payload_bytes": int(http.rsplit(b"Content-Length: ", 1)[1]),
        "refers_to": number("Refers-To-Page-ID"),
        "payload": payload,
    }


def ranges(rows: Iterable[tuple[str, int, int]], gap: int = MERGE_GAP, most: int = MAX_READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Merge sorted (file, offset, length) into reads: file, start, end, its records."""
    file, start, end, parts = "", 0, 0, []
    for name, offset, length in rows:
        if parts and (name != file or offset - end > gap or offset + length - start > most):
            yield file, start, end, parts
            parts = []
        if not parts:
            file, start, end = name, offset, offset
        parts.append((offset, length))
        end = max(end, offset + length)
    if parts:
        yield file, start, end, parts


def read_records(index: DataFrame) -> DataFrame:
    """Records of the selected index rows, with their payloads."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for file, start, end, parts in ranges(wanted):
            with shared_files.opened(file) as src:
                src.seek(start)
                raw = src.read(end - start)
            got = [parse_record(raw[o - start : o - start + n]) for o, n in parts]
            yield pa.record_batch([pa.array([g[c] for g in got], t) for c, t in zip(names, types)], names)

    slim = index.select("file", "offset", "length")
    asked = slim.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return slim.repartitionByRange(max(1, -(-asked // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def archive_digests(pages: DataFrame, **names) -> DataFrame:
    """Write, read back, and describe each record by what the archives hold.

    The digest of a response is taken anew from the payload that was read.
    """
    folder = shared_path(pages.sparkSession, "warc")
    back = read_records(write_archives(records(pages, **names), folder))
    response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return archive_digests(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder = page_id THEN NULL ELSE holder END AS refers_to
FROM q
"""
