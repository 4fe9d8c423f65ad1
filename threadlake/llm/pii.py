"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. Around them a field over the document's tokens
that hold a digit or an @ (and words equal to the name of a mailbox in it) looks
for what the patterns miss. It has a node per token with a label (none, email,
ip, card, phone), chain potentials between tokens that stand next to each other,
and skip potentials between distant tokens that are alike: the same name, the
same last four digits, or the same first three dotted numbers. The tokens of one
likeness hang on a hub of their own, so evidence goes from any mention to
any other in two steps however many stand between, and a token repeated n times
has n edges. Tokens inside base spans are observed, and with them what their hub's
key names in this document. Whether a free token of that hub is a mention stays
open: its own evidence counts against the hub's, so a name of letters only, or a
number behind a word that numbers something else (``OTHER``), is none. (With hubs
left free, no second mention reaches ``CONFIDENT``: the many tokens that look like
nothing outvote the one that is observed.) Loopy sum-product message passing,
damped, runs for each document until no message of it moves by ``SETTLED``; steps
shrink by ``CALMING`` a round, so every document settles, whatever others are in
the batch. Free tokens whose belief reaches ``CONFIDENT`` become added spans.

Training is by pseudo-likelihood, at the start of a run, on a bounded sample:
the ``SAMPLE_DOCS`` documents of smallest hash that hold a digit or an @ and are
no longer than ``SAMPLE_CHARS``. Its labels are the base spans. As those never
show a short second mention, each sampled span gets one, and decoys that are
labelled none: one of the same shape with other digits or letters, which only the
skip edges tell apart, and one that equals a mention but stands behind a word of
``OTHER`` or is the name of a mailbox that is a plain word. Every document is then
searched whole.

Edge cases: a null text is empty and has no spans; matches that fail a check
are dropped without another try inside them; with nothing to learn from no
span is added; repeated rows are searched alike; an empty table gives an empty
result; extra columns are ignored. Time is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import bound_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
SLICE_CHARS = 1 << 20
CONFIDENT = 0.9
SETTLED = 1e-3
DAMPING = 0.3
CALMING = 0.98
STEPS = 400
LIKENESSES = 3
FEATURES = 18

DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: A match of the ip rule can only begin where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^ \t\n\x0b\x0c\r]+")
EDGE = " \t.,;:!?\"'()[]<>{}"
#: Words after which a number counts, dates or numbers something else.
OTHER = ("on", "in", "of", "since", "until", "year", "day", "page", "line", "room", "order", "item", "part", "step", "chapter", "section", "version", "release", "build", "level", "size", "total", "about", "over", "under", "than")
BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*$")
GAP = re.compile(r"[\s.,;:!?\"'()\[\]<>{}+-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not NOT_LOCAL.match(text[start - 1]):
            start -= 1
        free = at + 1  # what stands before this @ is no part of a later name
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    if not MARK.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_is_byte, m.group().split(".")))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def tokens(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Bounds, without punctuation at their edges, of the tokens with a digit or
    an @ and of words that are the name of one of the base mailboxes."""
    if not MARK.search(text):
        return []
    names = {text[a:b].split("@")[0].lower() for a, k, b in base if k == 0}
    out = []
    for m in TOKEN.finditer(text):
        word = m.group()
        left = len(word) - len(word.lstrip(EDGE))
        bare = word.strip(EDGE)
        if bare and (MARK.search(bare) or (names and bare.lower() in names)):
            out.append((m.start() + left, m.start() + left + len(bare)))
    return out


def features(text: str, bounds: list[tuple[int, int]]) -> np.ndarray:
    rows = []
    for k, (a, b) in enumerate(bounds):
        t = text[a:b]
        d = _digits(t)
        parts = t.split(".")
        plus = text[max(0, a - 1) : a + 1]
        before = BEFORE.search(text, max(0, a - 40), a)
        near = k > 0 and a - bounds[k - 1][1] <= 3
        rows.append(
            (
                1.0,
                "@" in t,
                len(d) == len(t),
                any(c.isalpha() for c in t),
                len(parts) == 4 and all(p.isascii() and p.isdigit() and _is_byte(p) for p in parts),
                "-" in t,
                text[max(0, a - 1) : a] == "(",
                "+" in plus,
                near and "+" in text[max(0, bounds[k - 1][0] - 2) : a],
                len(d) <= 3,
                4 <= len(d) <= 8,
                9 <= len(d) <= 13,
                14 <= len(d) <= 19,
                len(d) > 19,
                14 <= len(d) <= 19 and luhn(d),
                "=" in t or "/" in t or '"' in t,
                t.isalpha(),
                not t.isalpha() and before is not None and before[1].lower() in OTHER,
            )
        )
    return np.array(rows, dtype=np.float64).reshape(len(bounds), FEATURES)


def likeness(token: str) -> tuple[int, str] | None:
    """(kind of likeness, key); tokens of one key are alike."""
    if "@" in token or any(c.isalpha() for c in token):
        return 0, token.split("@")[0].lower()
    parts = token.split(".")
    if len(parts) >= 3:
        return 2, ".".join(parts[:3])
    d = _digits(token)
    return (1, d[-4:]) if len(d) >= 4 else None


class Graph:
    """Nodes, edges and observed labels of many documents at once. The first
    nodes are tokens, the others hubs. Edges of table 0 are chain edges from
    left to right, those of table 1 + k go from a token to a hub of likeness k."""

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]):
        self.bounds: list[tuple[int, int, int]] = []
        rows, observed, chain, member = [], [], [], []
        self.hub_kind: list[int] = []
        for doc, (text, base) in enumerate(zip(texts, bases)):
            bounds = tokens(text, base)
            if not bounds:
                continue
            rows.append(features(text, bounds))
            first, alike, at = len(self.bounds), {}, 0
            for k, (a, b) in enumerate(bounds):
                label = 0
                while at < len(base) and base[at][2] <= a:
                    at += 1
                if at < len(base) and base[at][0] < b:
                    label = base[at][1] + 1
                observed.append(label)
                self.bounds.append((doc, a, b))
                if k and GAP.fullmatch(text, bounds[k - 1][1], a):
                    chain.append((first + k - 1, first + k))
                if key := likeness(text[a:b]):
                    alike.setdefault(key, []).append(first + k)
            for (kind, _), nodes in alike.items():
                if len(nodes) > 1:
                    member += [(n, len(self.hub_kind)) for n in nodes]
                    self.hub_kind.append(kind)
        self.x = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
        self.observed = np.array(observed, dtype=np.int64)
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.member = np.array(member, dtype=np.int64).reshape(-1, 2)
        kinds = np.array(self.hub_kind, dtype=np.int64)
        self.table = np.concatenate([np.zeros(len(chain), dtype=np.int64), 1 + kinds[self.member[:, 1]]])
        self.edges = np.concatenate([self.chain, self.member + [0, len(observed)]])


def _normal(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class Field:
    """``node`` is features x labels; ``pair[t]`` the potentials of edge table t,
    indexed by the label at the edge's first and at its second end."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair

    @classmethod
    def train(cls, texts: list[str]) -> Field | None:
        """Pseudo-likelihood: each token given its neighbours' labels. A hub's
        label, as its token sees it, is what most of its other tokens are."""
        bases = [base_spans(t) for t in texts]
        if not any(bases):
            return None
        texts, bases, decoys = with_second_mentions(texts, bases)
        g = Graph(texts, bases)
        hidden = np.array([any(start <= a < end for start, end in decoys[doc]) for doc, a, _ in g.bounds])
        g.observed[hidden] = 0
        one = np.eye(LABELS)
        y, n = one[g.observed], len(g.x)
        sides = []  # (token, neighbour's labels, table, whether the token is the edge's first end)
        sides.append((g.chain[:, 1], y[g.chain[:, 0]], 0, False))
        sides.append((g.chain[:, 0], y[g.chain[:, 1]], 0, True))
        total = np.zeros((len(g.hub_kind), LABELS))
        np.add.at(total, g.member[:, 1], y[g.member[:, 0]])
        others = total[g.member[:, 1]] - y[g.member[:, 0]]
        others[:, 0] = 0  # a hub is about something as soon as one token is
        for kind in range(LIKENESSES):
            at = np.array(g.hub_kind, dtype=np.int64)[g.member[:, 1]] == kind
            sides.append((g.member[at, 0], one[others[at].argmax(axis=1)], 1 + kind, True))
        node, pair = np.zeros((FEATURES, LABELS)), np.zeros((1 + LIKENESSES, LABELS, LABELS))
        # a label's tokens weigh alike however rare it is among the sample's
        weight = np.sqrt(n / (LABELS * np.maximum(1, y.sum(axis=0))))[g.observed][:, None]
        weight = weight / weight.sum()
        for _ in range(STEPS):
            score = g.x @ node
            for to, labels, t, first in sides:
                np.add.at(score, to, labels @ (pair[t].T if first else pair[t]))
            error = weight * (y - _normal(score))
            node += 4.0 * (g.x.T @ error - 1e-4 * node)
            for to, labels, t, first in sides:
                step = labels.T @ error[to]
                pair[t] += 4.0 * ((step.T if first else step) - 1e-4 * pair[t])
        # What a hub's label adds to all labels of a token alike is not learned
        # above; with this, tokens without evidence of their own move no hub.
        pair[1:] -= np.log(np.exp(pair[1:]).sum(axis=1, keepdims=True))
        return cls(node, pair)

    def potentials(self, g: Graph) -> np.ndarray:
        """Node potentials of all tokens and hubs. Observed tokens are fixed, and
        so is what a hub's key names, where one of its tokens is observed; what
        each free token of that hub is, its own evidence decides with the hub."""
        named = np.zeros((len(g.hub_kind), LABELS))
        np.add.at(named, (g.member[:, 1], g.observed[g.member[:, 0]]), 1)
        named[:, 0] = 0
        label = np.concatenate([g.observed, named.argmax(axis=1)])
        unary = np.concatenate([g.x @ self.node, np.zeros_like(named)])
        seen = np.flatnonzero(label)
        unary[seen] = -1e9  # more than any number of messages
        unary[seen, label[seen]] = 0.0
        return unary

    def beliefs(self, g: Graph) -> np.ndarray:
        """Label probabilities of every token after message passing."""
        tokens_, unary = len(g.x), self.potentials(g)
        if not len(g.edges):
            return _normal(unary[:tokens_])
        source = np.concatenate([g.edges[:, 0], g.edges[:, 1]])
        target = np.concatenate([g.edges[:, 1], g.edges[:, 0]])
        table = self.pair[g.table]
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(g.edges)) + len(g.edges), np.arange(len(g.edges))])
        message = np.zeros((len(source), LABELS))
        doc = np.array([doc for doc, _, _ in g.bounds], dtype=np.int64)[g.edges[:, 0]]
        doc = np.concatenate([doc, doc])
        live, step = np.arange(len(source)), 1 - DAMPING
        while len(live):
            total = unary.copy()
            np.add.at(total, target, message)
            out = (total[source[live]] - message[back[live]])[:, :, None] + table[live]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = step * (new - message[live])
            message[live] += change
            moving = np.zeros(doc.max() + 1, dtype=bool)
            moving[doc[live[np.abs(change).max(axis=1) >= SETTLED]]] = True
            live = live[moving[doc[live]]]
            step *= CALMING
        total = unary.copy()
        np.add.at(total, target, message)
        return _normal(total[:tokens_])


def second_mention(span: str, kind: int) -> str:
    """A short form in which something named in full is named again."""
    d = _digits(span)
    if kind == 0:
        return span.split("@")[0]
    if kind == 1:
        return span.rpartition(".")[0]
    if kind == 2:
        return d[-4:]
    return f"{d[-7:-4]}-{d[-4:]}"


def with_second_mentions(texts: list[str], bases: list) -> tuple[list[str], list, list[list[tuple[int, int]]]]:
    """Each text with a second mention of each base span behind it, labelled
    alike, and as many decoys, whose bounds are returned."""
    rng = random.Random(9)
    out, spans, decoys = [], [], []
    for text, base in zip(texts, bases):
        parts, at, more, false = [text], len(text), [], []
        for start, kind, end in base:
            short = second_mention(text[start:end], kind)
            if kind:
                parts += [" ", other := rng.choice(OTHER), " ", short]
                at += len(other) + 2
                false.append((at, at + len(short)))
                at += len(short)
            else:
                plain = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
                parts += [" and ", plain, "@example.org and ", plain]
                more.append((at + 5, kind, at + 17 + len(plain)))
                at += 22 + len(plain)
                false.append((at, at + len(plain)))
                at += len(plain)
            decoy = "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in short)
            for word, into in ((short, more), (decoy + ("" if MARK.search(decoy) else str(rng.randrange(10))), false)):
                parts += [" and ", word]
                into.append((at + 5, kind, at + 5 + len(word)) if into is more else (at + 5, at + 5 + len(word)))
                at += 5 + len(word)
        out.append("".join(parts))
        spans.append(base + more)
        decoys.append(false)
    return out, spans, decoys


def find_spans(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    bases = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if field is not None:
        g = Graph(texts, bases)
        if len(g.bounds):
            p = field.beliefs(g)
            label = p.argmax(axis=1)
            sure = (label > 0) & (p.max(axis=1) >= CONFIDENT) & (g.observed == 0)
            runs: list[list[int]] = []
            for k in np.flatnonzero(sure).tolist():
                doc, a, b = g.bounds[k]
                kind = int(label[k]) - 1
                if runs and runs[-1][0] == doc and runs[-1][2] == kind and not texts[doc][runs[-1][3] : a].strip(" ()-"):
                    runs[-1][3] = b
                else:
                    runs.append([doc, a, kind, b])
            for doc, a, kind, b in runs:
                added[doc].append((a - (kind == 3 and texts[doc][max(0, a - 1) : a] == "+"), kind, b))
    return list(zip(bases, added))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE_CHARS characters, one text at least."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def training_texts(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """The sample. Rows above a bound on the hash, which twice the sample is
    expected to stay below, are left out before anything is sorted, so that tasks
    send the driver some two samples together however many they are."""
    text, key = F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")
    marked = docs.select(key, text).filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64(F.lit("pii"), "id", "text"))
    n = marked.count()
    for share in (min(1.0, 2 * SAMPLE_DOCS / max(1, n)), 1.0):
        bound = min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))
        found = marked.filter(F.col("h") <= bound).orderBy("h", "id", "text").limit(SAMPLE_DOCS).collect()
        if len(found) >= min(n, SAMPLE_DOCS):
            break
    return [r.text for r in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and spans of every row."""
    field = Field.train(training_texts(docs, id_col, text_col))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for part in _slices(batch.column(1).fill_null("").to_pylist()) for f in find_spans(part, field)]
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            yield pa.record_batch(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(write(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([write(base + more) for base, more in found], pa.string()),
                ],
                names,
            )

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
