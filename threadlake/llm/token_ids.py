"""Token ids in a byte-aligned file format.

Ids are replaced by their frequency rank, so that the 256 most frequent tokens
take one byte and the rest mostly two. Each value takes 1 to 4 little-endian
data bytes; its length less one is a 2-bit code, four codes to a control byte,
and control bytes stand apart from the data. A reader looks each control byte
up in a 256-row table of lengths and gathers all values of a block at once.

Layout of a shard: blocks, each a 40-byte header (magic, documents, values,
control bytes, data bytes), then doc ids (int64), null marks (uint8), counts
(uint32), control bytes, data. Documents stand in ascending id order (null ids
first; rows of equal id in order of their ids' bytes), within a shard and from shard to
shard. ``ranks.bin`` holds the id of every rank (uint32).

Edge cases: a null or empty text is the end id alone; repeated rows are each
kept; special strings inside a text are what the tokenizer makes of them; an
empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm import shared_files, worker
from threadlake.session import bound_batches, materialize, shared_path

END_ID = 2
MAGIC = b"TLIDBLK1"
HEADER = "<8s4Q"
HEADER_BYTES = struct.calcsize(HEADER)
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 24
CACHE_WORDS = 1_500_000
SLICE_BYTES = 1 << 20

#: Bytes each of a control byte's four values takes.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = size
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        wide = size > k
        if not wide.any():
            break
        out[wide] |= raw[starts[wide] + k].astype(np.uint32) << (8 * k)
    return out


class WordEncoder:
    """Encodes texts word by word with a bounded memory of words seen.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its space-separated words. The words that a slice of texts
    brings anew are encoded in two calls of the tokenizer. Words of small ASCII
    letters need no normalizing or splitting, and punctuation behind them is a
    piece of its own, so they are merged as they are and share their memory with
    the same word elsewhere; all other words go through the whole tokenizer.
    """

    TAIL = b".,;:!?*$%&#|"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(bare))
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}

    def _encode(self, tokenizer, new: list[bytes]) -> None:
        found = tokenizer.encode([w.decode() for w in new], is_pretokenized=True, add_special_tokens=False)
        packed = np.array(found.ids, dtype=self.width).tobytes()
        ends = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(new)), side="right")
        start = 0
        for word, end in zip(new, (ends * np.dtype(self.width).itemsize).tolist()):
            self.words[word] = packed[start:end]
            start = end

    def _learn(self, new: Iterable[bytes]) -> None:
        words = self.words
        plain, other, joined = set(), set(), []
        for word in new:
            stem = word.rstrip(self.TAIL)
            if stem.isalpha() and stem.islower():
                if stem not in words:
                    plain.add(stem)
                if len(stem) < len(word):
                    tail = word[len(stem) :]
                    joined.append((word, stem, tail))
                    if tail not in words:
                        other.add(tail)
            else:
                other.add(word)
        if plain:
            self._encode(self.merger, list(plain))
        if other:
            self._encode(self.tokenizer, list(other))
        for word, stem, tail in joined:
            words[word] = words[stem] + words[tail]

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, end to end in ``width``."""
        # Bytes split at space and \t..\r alone, and lower-case A-Z alone. The
        # tokenizer lower-cases too, but knows its special strings before that.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        fresh = set().union(*split)
        missing = fresh.difference(self.words)
        if len(self.words) + len(missing) > self.cache_words:
            self.words.clear()
            missing = fresh
        if missing:
            self._learn(missing)
        seen = self.words.__getitem__
        return [b"".join(map(seen, words)) for words in split]


def word_encoder(path: str, cache_words: int) -> WordEncoder:
    return worker.hold(("words", path, cache_words), lambda: WordEncoder(path, cache_words))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit, packed to 16 bits where all fit).

    ``cache_words`` trades a worker's memory, some 200 bytes a word, for time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path, cache_words)
        mark, end = (b"\2", struct.pack("<H", end_id)) if encoder.width == "<u2" else (b"\4", struct.pack("<I", end_id))
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
                packed = [mark + ids + end for ids in encoder.packed(texts[at:to].to_pylist())]
                counts = [(len(p) - 1) // len(end) for p in packed]
                yield pa.record_batch([batch.column(0)[at:to], pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])
                at = to

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u2" if packed[0] == 2 else "<u4", offset=1).astype(np.uint32)


def token_counts(encoded: DataFrame) -> DataFrame:
    """token_id, n over the whole corpus; a row per token seen leaves each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                here = np.bincount(np.concatenate([unpack(x.as_py()) for x in batch.column(0)]))
                if len(here) > len(total):
                    total = np.pad(total, (0, len(here) - len(total)))
                total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token_id", "n"])

    return encoded.select("ids").mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_shards(encoded: DataFrame, folder: str, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the corpus in id order; returns the manifest (shard_no, file, n_docs, n_ids).

    The rank table has a row per token of the vocabulary, which bounds what the
    driver collects and sends to the tasks.
    """
    spark = encoded.sparkSession
    counts = token_counts(encoded).collect()
    by_rank = np.array([r.token_id for r in sorted(counts, key=lambda r: (-r.n, r.token_id))], dtype="<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    with shared_files.create(f"{folder}/ranks.bin") as out:
        out.write(by_rank.tobytes())
    ranks = spark.sparkContext.broadcast(rank_of)
    shards = max(1, -(-sum(r.n for r in counts) // shard_tokens))

    def block(ids: list, values: list[np.ndarray]) -> bytes:
        flat = ranks.value[np.concatenate(values)]
        control, data = encode_values(flat)
        nulls = np.array([i is None for i in ids], dtype=np.uint8)
        keys = np.array([i or 0 for i in ids], dtype="<i8")
        sizes = np.array([len(v) for v in values], dtype="<u4")
        head = struct.pack(HEADER, MAGIC, len(ids), len(flat), len(control), len(data))
        return b"".join([head, keys.tobytes(), nulls.tobytes(), sizes.tobytes(), control, data])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), unpack(x.as_py())) for b in batches for i, x in zip(b.column(0), b.column(1)))
        first = next(rows, None)
        if first is None:
            return
        number = TaskContext.get().partitionId()
        name = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.tlid"
        n_docs = n_ids = held = 0
        ids, values = [], []
        with shared_files.create(name) as out:
            while first is not None:
                ids.append(first[0])
                values.append(first[1])
                held += len(first[1])
                n_docs += 1
                n_ids += len(first[1])
                first = next(rows, None)
                if held >= block_tokens or first is None:
                    out.write(block(ids, values))
                    ids, values, held = [], [], 0
        yield pa.record_batch([[number], [name], [n_docs], [n_ids]], ["shard_no", "file", "n_docs", "n_ids"])

    ordered = encoded.select("doc_id", "ids").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return materialize(ordered.mapInArrow(run, "shard_no long, file string, n_docs long, n_ids long"), "token-manifest")


def read_blocks(uri: str, by_rank: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, sizes and token ids of each block of a shard."""
    with shared_files.opened(uri) as src:
        while head := src.read(HEADER_BYTES):
            magic, docs, n, n_control, n_data = struct.unpack(HEADER, head)
            if magic != MAGIC:
                raise ValueError(f"{uri}: not a block")
            keys = np.frombuffer(src.read(8 * docs), dtype="<i8")
            nulls = np.frombuffer(src.read(docs), dtype=np.uint8)
            sizes = np.frombuffer(src.read(4 * docs), dtype="<u4").astype(np.int64)
            control, data = src.read(n_control), src.read(n_data)
            yield [None if z else int(k) for k, z in zip(keys, nulls)], sizes, by_rank[decode_values(control, data, n)]


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files have them."""
    before = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if by_rank is None:
                    with shared_files.opened(f"{folder}/ranks.bin") as src:
                        by_rank = np.frombuffer(src.read(), dtype="<u4")
                for keys, sizes, ids in read_blocks(name, by_rank):
                    ends = np.cumsum(sizes)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                    yield pa.record_batch(
                        [pa.array(keys, pa.int64()), pa.array(base + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    base += int(ends[-1])

    n = max(1, manifest.count())
    return based.select("file", "base").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_corpus(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Encode, write in the file format, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_path(docs.sparkSession, "token-files")
    encoded = materialize(encode(docs, tokenizer_path, **options), "token-ids")
    return read_digests(write_shards(encoded, folder), folder)


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return binary_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
