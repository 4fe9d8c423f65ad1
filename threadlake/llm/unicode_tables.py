"""What this Python's Unicode tables leave open."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: White space of the tokenizers' patterns, as a regex class body.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class CodePoints:
    """A set of code points, looked up by number: a pattern's class tries its
    ranges beyond U+FFFF one by one at every character."""

    SLICE = 1 << 16

    def __init__(self, members: Iterable[bool]):
        self.table = np.fromiter(members, dtype=bool, count=sys.maxunicode + 1)

    def search(self, text: str) -> bool:
        """Whether a member is in the text."""
        for at in range(0, len(text), self.SLICE):
            points = np.frombuffer(text[at : at + self.SLICE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            if self.table[points].any():
                return True
        return False


@lru_cache(maxsize=1)
def unassigned() -> CodePoints:
    """Code points that are unassigned in this Python's Unicode tables. Later
    versions of Unicode class them, and libraries differ in which they know."""
    return CodePoints(unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1))


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for
    themselves, the others for code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


def stand_in(piece: str) -> str:
    """A piece as a byte-level model knows it."""
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    return piece.encode().decode("latin-1").translate(byte_alphabet())
