"""Boolean trigram queries of regular expressions.

A query is a list of conditions that must all hold (none: no trigram is
mandatory, scan everything). A condition is a list of alternatives, each a set
of trigrams that must all occur; any text that the expression matches holds
every trigram of at least one alternative of each condition. Matching is on
lower case, so one index serves rules of either case.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

MAX_STRINGS = 32


def _cross(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MAX_STRINGS else None


class _Sequence:
    """Runs of exact alternatives in reading order, parted by inexact gaps."""

    def __init__(self) -> None:
        self.runs: list[set[str]] = [{""}]

    def exact(self, strings: set[str]) -> None:
        joined = _cross(self.runs[-1], strings)
        if joined is None:
            self.runs.append(strings)
        else:
            self.runs[-1] = joined

    def gap(self) -> None:
        self.runs.append({""})

    def extend(self, other: list[set[str]]) -> None:
        self.exact(other[0])
        self.runs += other[1:]


def _runs(tree) -> list[set[str]]:
    seq = _Sequence()
    for code, arg in tree:
        if code is op.LITERAL:
            seq.exact({chr(arg).lower()})
        elif code is op.IN and not any(kind in (op.NEGATE, op.CATEGORY) for kind, _ in arg):
            chars = set()
            for kind, value in arg:
                chars |= {chr(value).lower()} if kind is op.LITERAL else {chr(c).lower() for c in range(value[0], min(value[1], value[0] + MAX_STRINGS + 1) + 1)}
            seq.exact(chars) if len(chars) <= 8 else seq.gap()
        elif code is op.SUBPATTERN:
            seq.extend(_runs(arg[-1]))
        elif code is op.BRANCH:
            branches = [_runs(b) for b in arg[1]]
            if all(len(b) == 1 for b in branches):
                seq.exact(set().union(*(b[0] for b in branches)))
            else:
                seq.gap()
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            body = _runs(inner)
            if (low, high) == (0, 1) and len(body) == 1:
                seq.exact(body[0] | {""})
            else:
                for _ in range(min(low, 3)):
                    seq.extend(body)
                if high != low or low > 3:
                    seq.gap()
        elif code is op.AT:
            continue
        else:
            seq.gap()
    return seq.runs


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def query(pattern: str) -> list[list[frozenset[str]]]:
    """A condition for each exact run of a pattern all of whose alternatives
    have trigrams."""
    conditions = []
    for run in _runs(parser.parse(pattern)):
        found = {trigrams(s) for s in run}
        if all(found):
            least = sorted({a for a in found if not any(b < a for b in found)}, key=sorted)
            if least not in conditions:
                conditions.append(least)
    return conditions
