"""Language identification by cross-parsing.

Per language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed from left to right into the longest phrases that occur
in a language's sample; the fewer phrases per letter, the closer the language.
Phrase counts are normalised by the information a phrase carries (the logarithm
of the sample's length), and the language with the fewest wins.

Texts are lower-cased; runs of anything but letters are one space. A letter that
a sample has not is a phrase of its own. A text is parsed whole: its stretches of
``STRETCH`` letters are run side by side, then again from the state in which the
stretch before ended, until no state changes, so a phrase may be of any length.

The sample per language is the only thing that is bounded: ``SAMPLE_DOCS``
documents of smallest hash, of each a passage of ``PASSAGE`` characters that
begins at a place drawn from the hash. Each task passes on its few smallest
hashes. Every letter of a sample is a symbol of its language: the most frequent
in a dense table, the rest in a sorted list of transitions. How many are dense is
a matter of speed only.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null
label teaches nothing; a null id hashes as the empty string; rows equal in id and
text are sampled once; equal counts go to the first language in order; with no labelled row every text is ``und``; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm import worker
from threadlake.session import bound_batches

SAMPLE_DOCS = 64
PASSAGE = 500
DENSE_LETTERS = 62
DENSE_BYTES = 1 << 27
STRETCH = 256
SLICE_CHARS = 1 << 19
FOLDS = 5
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[str]]]:
    """(lang, texts) per language, in order of language."""
    eligible = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text")
    )

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set[int]] = {}
        for batch in batches:
            for lang, h in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(lang, set()).add(h)
            found = {lang: set(heapq.nsmallest(SAMPLE_DOCS, own)) for lang, own in found.items()}
        rows = [(lang, h) for lang, own in found.items() for h in own]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["lang", "h"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = eligible.select("lang", "h").mapInArrow(smallest, "lang string, h long").distinct().withColumn("place", place).filter(F.col("place") <= SAMPLE_DOCS)
    wanted = docs.sparkSession.createDataFrame(chosen.select("lang", "h").collect(), "lang string, h long")
    begin = F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.length("text") - PASSAGE + 1)).cast("int")
    passage = eligible.join(F.broadcast(wanted), ["lang", "h"]).select("lang", "h", F.substring("text", begin, F.lit(PASSAGE)).alias("text")).dropDuplicates(["lang", "h"])
    texts: dict[str, list[str]] = {}
    for row in sorted(passage.collect(), key=lambda r: (r.lang, r.h)):
        texts.setdefault(row.lang, []).append(row.text)
    return sorted(texts.items())


def _letters(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def transitions(symbols: list[int]) -> list[dict[int, int]]:
    """{symbol: next} of each state of the smallest automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = now
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[now] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    return step


def _triples(step: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, symbol, next) of all transitions."""
    state = np.repeat(np.arange(len(step)), [len(d) for d in step])
    return state, np.array([c for d in step for c in d], dtype=np.int64), np.array([to for d in step for to in d.values()], dtype=np.int64)


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """next[state, symbol] of the smallest automaton of all substrings; -1: none."""
    step = transitions(symbols)
    state, symbol, to = _triples(step)
    table = np.full((len(step), width), -1, dtype=np.int32)
    table[state, symbol] = to
    return table


class Automaton:
    """One language. Symbols: 0 is the space, then the dense letters, then a
    letter it has not, then padding, then its rarer letters. The last state is
    the one behind a letter it has not: whatever follows begins a phrase."""

    def __init__(self, coded: np.ndarray, n_letters: int, dense: int):
        counts = np.bincount(coded, minlength=n_letters + 3)
        counts[0] = 0
        order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        dense = min(dense, len(order))
        self.other, self.pad, self.width = dense + 1, dense + 2, dense + 3
        self.symbol = np.full(n_letters + 3, self.other, dtype=np.int32)
        self.symbol[0], self.symbol[n_letters + 2] = 0, self.pad
        self.symbol[order[:dense]] = np.arange(dense) + 1
        self.symbol[order[dense:]] = np.arange(len(order) - dense) + self.width
        step = transitions(self.symbol[coded].tolist())
        state, symbol, to = _triples(step)
        common = symbol < self.width
        # next state and, in the lowest bit, whether a phrase ends
        root = np.zeros(self.width + len(order) - dense, dtype=np.int32)
        for c, at in step[0].items():
            root[c] = at
        lost = len(step)
        again = np.where(root > 0, root, lost) * 2 + 1
        table = np.repeat(again[None, : self.width].astype(np.int32), len(step) + 1, axis=0)
        table[0] -= 1
        table[state[common], symbol[common]] = to[common] * 2
        table[:, self.pad] = 0
        self.table = table.reshape(-1)
        self.rare = max(1, len(order) - dense)
        self.root = again[self.width :].astype(np.int32)
        key = state[~common] * self.rare + symbol[~common] - self.width
        by = np.argsort(key)
        self.keys, self.to = key[by], (to[~common][by] * 2).astype(np.int32)

    def run(self, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended in each column from the given states, and its last state."""
        grid, state = self.symbol[grid], state.copy()
        rarer = (grid >= self.width).any(axis=1)
        total = np.zeros(grid.shape[1], dtype=np.int32)
        for row, some in zip(grid, rarer):
            if some:
                at = np.flatnonzero(row >= self.width)
                letter = row[at].astype(np.int64) - self.width
                key = state[at].astype(np.int64) * self.rare + letter
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                packed = self.table.take(state * self.width + np.minimum(row, self.other))
                packed[at] = np.where(self.keys[place] == key, self.to[place], self.root[letter])
                # padding lies above `other`
                packed[row == self.pad] = 0
            else:
                state *= self.width
                state += row
                packed = self.table.take(state)
            total += packed & 1
            state = packed >> 1
        return total, state

    def phrases(self, grid: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases ended in each column, where a column goes on from the one
        before unless it is the first of its text."""
        ended = np.zeros(grid.shape[1], dtype=np.int32)
        start, last = np.zeros_like(ended), np.zeros_like(ended)
        todo = np.arange(len(ended))
        while len(todo):
            ended[todo], last[todo] = self.run(grid[:, todo], start[todo])
            now = np.where(first, 0, np.roll(last, 1))
            todo = np.flatnonzero(now != start)
            start = now
        return ended


class CrossParser:
    """Letters are numbered over all samples; then any other letter, then padding."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in samples]
        alphabet = sorted({c for _, text in samples for c in text} - {" "})
        self.other, self.pad = len(alphabet) + 1, len(alphabet) + 2
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.symbol = np.where(letters, self.other, 0).astype(np.int32)
        for k, c in enumerate(alphabet):
            self.symbol[ord(c)] = k + 1
        # an automaton has at most two states a letter
        room = DENSE_BYTES // (8 * sum(len(text) for _, text in samples)) - 3
        dense = max(0, min(DENSE_LETTERS, room))
        self.automata = [Automaton(self.symbol[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")], len(alphabet), dense) for _, text in samples]
        self.weight = np.array([np.log2(max(2, len(text))) for _, text in samples])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per language and text, symbols per text)."""
        lowered = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in lowered])
        coded = self.symbol[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        doc = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(doc[coded > 0], minlength=len(texts))
        keep = np.ones(len(coded), dtype=bool)
        keep[1:] = (coded[1:] != 0) | (coded[:-1] != 0) | (doc[1:] != doc[:-1])
        coded, doc = coded[keep], doc[keep]
        sizes = np.bincount(doc, minlength=len(texts))
        offset = np.arange(len(coded)) - (np.cumsum(sizes) - sizes)[doc]
        stretches = -(-sizes // STRETCH)
        first = np.cumsum(stretches) - stretches
        grid = np.full((min(STRETCH, int(sizes.max(initial=0))), int(stretches.sum())), self.pad, dtype=np.int32)
        grid[offset % STRETCH, first[doc] + offset // STRETCH] = coded
        owner = np.repeat(np.arange(len(texts)), stretches)
        opens = np.diff(owner, prepend=-1) != 0
        ended = (a.phrases(grid, opens) for a in self.automata)
        return np.stack([np.bincount(owner, weights=e, minlength=len(texts)) for e in ended]) + (sizes > 0), letters


def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return worker.hold(("languages", samples), lambda: CrossParser(samples))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    samples = tuple((lang, text) for lang, texts in training_sample(docs, id_col, text_col, lang_col) if (text := _letters(" ".join(texts))).strip())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples) if samples else None
        for batch in batches:
            texts = batch.column(2).fill_null("").to_pylist()
            langs, scores, at = [], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_CHARS):
                    size += len(texts[to])
                    to += 1
                if model is None:
                    langs += [UNKNOWN] * (to - at)
                    scores += [0.0] * (to - at)
                else:
                    count, letters = model.phrases(texts[at:to])
                    cost = count * model.weight[:, None]
                    best = cost.argmin(axis=0)
                    odds = 1 / np.exp(np.minimum(0, cost.min(axis=0) - cost)).sum(axis=0)
                    for k in range(to - at):
                        langs.append(model.languages[best[k]] if letters[k] else UNKNOWN)
                        scores.append(float(odds[k]) if letters[k] else 0.0)
                at = to
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
