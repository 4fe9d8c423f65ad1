"""Words, lines and shingles of many texts at once, as numpy arrays.

Texts are laid end to end as UTF-8 bytes in slices of about ``SLICE_BYTES``
(one text at least), so memory stays bounded and no text is looked at in a
Python loop. Words and lines are compared by 64-bit polynomial hashes of their
bytes; two different ones agree with odds of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SHINGLE = 5
PARITY_LONGS = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_CONTINUATION = (np.arange(256) & 0xC0) == 0x80

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("_powers", _BASE), ("_inverse", _BASE_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers[:n], _inverse[:n]


class Grid:
    """One slice: ``starts``/``ends`` are byte bounds of each text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool):
        self.raw = data
        self.n_docs = len(starts)
        self.starts, self.ends = starts, ends
        self.data = LOWER[data] if lower else data
        powers, self._inv = _power_tables(len(data) + 1)
        self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * powers[:-1], out=self._prefix[1:])
        solid = ~IS_SPACE[data]
        self.solid = solid
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        full = ends > starts
        edge = starts[full]
        opens[edge] = solid[edge]
        edge = ends[full] - 1
        closes[edge] = solid[edge]
        self.word_start = np.flatnonzero(opens)
        self.word_end = np.flatnonzero(closes) + 1
        self.word_doc = np.searchsorted(ends, self.word_start, side="right")
        self.n_words = np.bincount(self.word_doc, minlength=self.n_docs)
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        return mix((self._prefix[end] - self._prefix[start]) * self._inv[start] + (end - start).astype(np.uint64))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        upto = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=upto[1:])
        return upto[self.ends] - upto[self.starts]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text and hash of every window of five words inside a text."""
        word = self.hashes(self.word_start, self.word_end)
        first = np.arange(max(0, len(word) - SHINGLE + 1))
        first = first[self.word_doc[first] == self.word_doc[first + SHINGLE - 1]] if len(first) else first
        total = np.zeros(len(first), dtype=np.uint64)
        for k in range(SHINGLE):
            total += word[first + k] * _PLACE[k]
        return first, self.word_doc[first], mix(total)

    def shingle_sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, hash), sorted by text: the windows of five words, or
        the whole sequence of a text with one to four words."""
        _, doc, code = self.windows()
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < SHINGLE))
        if len(short):
            word = self.hashes(self.word_start, self.word_end)
            total = self.n_words[short].astype(np.uint64)
            for k in range(SHINGLE - 1):
                has = self.n_words[short] > k
                total[has] += word[self.first_word[short[has]] + k] * _PLACE[k]
            doc = np.concatenate([doc, short])
            code = np.concatenate([code, mix(total)])
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        keep = np.ones(len(doc), dtype=bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        return doc[keep], code[keep]


def parities(doc: np.ndarray, code: np.ndarray, n_docs: int) -> pa.Array:
    """Per set of hashes: for each of ``64 * PARITY_LONGS`` ranges of hashes,
    whether an odd number of its members falls there. Two sets differ in at
    least as many members as their parities differ in bits."""
    spread = mix(code ^ np.uint64(0x8E9D5A3C71F02B47))
    made = np.zeros((n_docs, PARITY_LONGS), dtype=np.uint64)
    np.bitwise_xor.at(made, (doc, (spread & np.uint64(PARITY_LONGS - 1)).astype(np.int64)), np.uint64(1) << (spread >> np.uint64(58)))
    flat = pa.array(made.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PARITY_LONGS, dtype=np.int32)), flat)


def near_by_parities(percent: int, odd: str, n: str, other_odd: str, other_n: str) -> str:
    """SQL: whether parities allow two sets of sizes n a similarity of so many percent."""
    differ = " + ".join(f"bit_count({odd}[{k}] ^ {other_odd}[{k}])" for k in range(PARITY_LONGS))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * ({n} + {other_n})"


def seen_before(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, hash) entries in order: whether an equal one stands earlier in
    the text, and whether an equal one stands anywhere else in it."""
    order = np.lexsort((code, doc))
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1])
    other = same.copy()
    other[:-1] |= same[1:]
    earlier, anywhere = np.empty_like(same), np.empty_like(same)
    earlier[order], anywhere[order] = same, other
    return earlier, anywhere


def grids(texts: pa.Array, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, Grid]]:
    """(index of its first text, Grid) for each slice of a column; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + slice_bytes, side="right")) - 1)
        to = min(to, n)
        low = bounds[at]
        yield at, Grid(data[low : bounds[to]], bounds[at:to] - low, bounds[at + 1 : to + 1] - low, lower)
        at = to
