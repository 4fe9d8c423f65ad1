"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is run through the merges once; those
that come back as a single token are *whole*. A text is split into pre-tokens;
a whole pre-token counts one token with no merging, and only the rest are
merged (each distinct one once while the worker remembers it).

A space begins a pre-token wherever the white space around it does not run on
over it, so a text is taken apart at spaces first, and what lies between two is
split, looked up and merged once while the worker remembers its count. Texts
with longer runs of white space are split as a whole.

The split follows the tokenizer's own byte-level pattern with its white-space
class written out, and special strings inside a text are one token each and
part the text, which is the library's default. A text with a code point that is
unassigned in this Python's Unicode tables is left to the library as a whole, as
the two splits may class it differently. Edge cases: a null text is
empty and has no token; ties and repeated rows are separate rows; an empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import worker
from threadlake.llm.unicode_tables import SPACE, byte_alphabet, stand_in, unassigned
from threadlake.session import bound_batches

TOKEN_LIMIT = 1024
CACHE_PIECES = 300_000
CACHE_WORDS = 500_000
LONGEST_KEPT = 64  # characters; longer pieces and words are not remembered
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class WordCounts(dict):
    """Tokens of a space and the word behind it, counted when first asked for."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(" " + word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


class PieceCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer
        self.merge = tokenizer.model.tokenize
        self.unassigned = unassigned()
        self.split = regex.compile(PATTERN).findall
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.whole = self._whole_tokens(tokenizer)
        self.merged: dict[str, int] = {}
        self.words = WordCounts(self._pieces)
        # White space on both sides of a space, or before the last one.
        self.runs_on = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)").search

    def _whole_tokens(self, tokenizer) -> frozenset[str]:
        """Strings of the vocabulary that the merges leave as one token."""
        back = {c: b for b, c in byte_alphabet().items()}
        found = []
        for token in tokenizer.get_vocab(with_added_tokens=False):
            try:
                string = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):  # not a whole number of characters: no pre-token is that
                continue
            if len(self.merge(token)) == 1:
                found.append(string)
        return frozenset(found)

    def _rest(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.merge(stand_in(piece)))
            if len(piece) <= LONGEST_KEPT:
                if len(self.merged) >= CACHE_PIECES:
                    self.merged.clear()
                self.merged[piece] = n
        return n

    def _pieces(self, text: str) -> int:
        pieces = self.split(text)
        whole = self.whole
        rest = [p for p in pieces if p not in whole]
        return len(pieces) - len(rest) + sum(map(self._rest, rest))

    def _words(self, text: str) -> int:
        if self.runs_on(text):
            return self._pieces(text)
        first, *words = text.split(" ")
        return self._pieces(first) + sum(map(self.words.__getitem__, words))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() and self.unassigned.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._words, parts))
        return self._words(text)


def piece_counter(path: str) -> PieceCounter:
    return worker.hold(("pieces", path), lambda: PieceCounter(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer_path)
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    counted = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
