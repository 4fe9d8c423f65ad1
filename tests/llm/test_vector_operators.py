"""Whitening and codes of vectors, against plain Python."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from threadlake.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 7, "c", "d") for i, v, x in rows], SCHEMA)


def planted(seed=5, n=150, d=32):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 0.2 + 0.01 * j) for j in range(d)], rng.choice([1, 2, None])) for k in range(n)]
    rows += [(k, rows[3][1], 2) for k in range(n, n + 60)]  # copies of one vector
    rows.append((3, rows[3][1], rows[3][2]))  # a repeated row
    rows.append((None, rows[9][1], None))
    bad = [(900, None, 1), (901, [], 1), (902, [math.nan] * d, 1), (903, [math.inf] + [0.0] * (d - 1), 1), (904, [None] + [0.0] * (d - 1), 1), (905, [0.5] * (d - 1), 1)]
    return rows, rows + bad


def singles(v):
    return [float(np.float32(c)) for c in v]


# --- whitening -------------------------------------------------------------


def test_whitening_against_fractions(spark):
    rows, table = planted()
    levels = [[math.floor(64 * c) + 1_000_000 for c in singles(v)] for _, v, _ in rows]
    n, d = len(rows), len(levels[0])
    sums = [sum(x[j] for x in levels) for j in range(d)]
    centred = np.array([[float(Fraction(x[j] * n - sums[j], n)) for j in range(d)] for x in levels])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    want = {}
    for (i, _, _), x, y in zip(rows, levels, centred):
        away = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(32):
            want.setdefault((i, c + 1), []).append((away, float(y @ axes[:, -1 - c]) / math.sqrt(values[-1 - c]), values[-1 - c] / values.sum()))
    got = whitening.whiten(frame(spark, table)).collect()
    assert len(got) == 32 * n
    signs = {}
    for r in got:
        options = want[r.vec_id, r.component]
        assert r.n == n and r.deviation in {o[0] for o in options} and r.deviation_exact == str(r.deviation)
        assert r.identity_error < 1e-9 and abs(r.explained / options[0][2] - 1) < 1e-9
        if abs(options[0][1]) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * options[0][1]))
        assert any(abs(abs(r.whitened) - abs(o[1])) < 1e-6 for o in options)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_edges(spark):
    none = whitening.whiten(frame(spark, []))
    assert none.columns[:4] == ["vec_id", "component", "n", "deviation"] and none.count() == 0
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(frame(spark, [(k, [float(k), 5.0, 2.0 * k], 1) for k in range(9)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and {r.identity_error < 1e-9 for r in flat} == {True}
    huge = whitening.whiten(frame(spark, [(1, [3.0e38, 1.0], 1), (2, [-3.0e38, 2.0], 1), (3, [0.0, 3.0], 1)])).collect()
    top = [math.floor(min(max(64 * float(np.float32(c)), -(2.0**60)), 2.0**60)) + 1_000_000 for c in (3.0e38, -3.0e38, 0.0)]
    side = [64 * c + 1_000_000 for c in (1, 2, 3)]
    assert {r.deviation for r in huge if r.vec_id < 3} == {None}
    assert {(r.vec_id, int(r.deviation_exact)) for r in huge} == {(k + 1, (3 * top[k] - sum(top)) ** 2 + (3 * side[k] - sum(side)) ** 2) for k in range(3)}


def test_whitening_of_columns_named_alike(spark):
    rows = frame(spark, planted(n=40)[1]).withColumnRenamed("label", "Vector").withColumnRenamed("code", "DEVIATION")
    assert whitening.whiten(rows, components=3).count() == 3 * (40 + 60 + 2)


# --- codes -----------------------------------------------------------------


def codes_plain(rows, parts=16, entries=64):
    vectors = [[math.floor(256 * c) for c in singles(v)] for _, v, _ in rows]
    vectors = [v + [0] * (-len(v) % parts) for v in vectors]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(2):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, x), e in zip(rows, error):
        by[x] = by.get(x, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by[x], digest) for (i, _, x), f, e in zip(rows, found, error)]


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("d", [32, 40])
def test_codes_against_plain(spark, d):
    rows, table = planted(seed=d, d=d)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in vector_codes.compress(frame(spark, table)).collect()), key=str)
    assert got == sorted(codes_plain(rows), key=str)


def test_codes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST_LABELS", -1)
    test_codes_against_plain(spark, 32)


def test_codes_edges(spark):
    assert vector_codes.compress(frame(spark, [])).columns == [*COLUMNS, "label"]
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    few = [(k, [float(k)] * 16, None) for k in range(5)]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in vector_codes.compress(frame(spark, few)).collect()) == codes_plain(few)
    huge = vector_codes.compress(frame(spark, [(k, [(-1.0) ** k * 1e30] * 16, k % 2) for k in range(70)])).collect()
    assert len(huge) == 70 and {r.error for r in huge} == {0}
    rows = frame(spark, planted(n=20)[1]).withColumnRenamed("code", "Exact").withColumnRenamed("n", "VECTOR")
    assert vector_codes.compress(rows).count() == 82


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16])
def test_bounds_lose_no_nearest(width):
    rng = np.random.default_rng(width)
    for spread in (3, 300, 1 << 20, 1 << 40):
        x, entries = (rng.integers(-spread, spread, (n, width)) for n in (400, 64))
        entries[40:] = entries[:24]  # ties
        x[:64] = entries
        away = ((x.astype(object)[:, None, :] - entries.astype(object)[None]) ** 2).sum(axis=2)
        code, least = vector_codes.nearest(x, entries)
        assert code.tolist() == [min(range(64), key=row.__getitem__) for row in away]
        assert [int(v) for v in least] == [min(row) for row in away]

