"""Near duplicates by the LSH forest, against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from threadlake.llm import lsh_forest

SCHEMA = "doc_id long, text string, N long, Label string, sig string, region long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(900)}" for _ in range(n)]


def changed(rng, text, k):
    text = list(text)
    for _ in range(k):
        text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    return text


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^ \t-\r]+", lowered)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def by_all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    found = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in groups[root(k)] if x is not None]
        least = min(ids) if ids else None
        found.append((i, len(sets[k]), least, i == least))
    return sorted(found, key=str)


def planted():
    rng = random.Random(11)
    shared = words(rng, 60)
    rows = [(k, " ".join(words(rng, rng.randrange(5, 200)))) for k in range(60)]
    base = words(rng, 200)
    rows += [(100 + k, " ".join(changed(rng, base, 3))) for k in range(40)]  # copies of one original, not of one another
    rows.append((99, " ".join(base)))
    rows += [(200 + k, " ".join(shared + words(rng, 12))) for k in range(40)]  # boilerplate, alike but not linked
    chain = words(rng, 120)
    for k in range(12):
        chain = changed(rng, chain, 1)
        rows.append((300 + k, " ".join(chain)))
    rows += [(400, " ".join(words(rng, 20_000))), (401, None), (402, ""), (403, " \n "), (404, "One two"), (405, "one TWO"), (406, "one two three"), (None, "one two"), (None, None)]
    rows += [(500 + k, rows[0][1]) for k in range(20)] + [rows[0], rows[70], (None, rows[5][1] + " tail"), (None, "only nulls here at all"), (None, "only nulls here at all")]
    return rows


def test_forest_against_all_pairs(spark):
    rows = planted()
    got = lsh_forest.near_duplicates(docs_of(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_all_pairs(rows)


@pytest.mark.parametrize("room, most", [(0, lsh_forest.MAX_BROADCAST_ROWS), (10**9, -1)])
def test_crowded_regions_and_no_broadcasts(spark, monkeypatch, room, most):
    """Every open region split to the last depth, and none."""
    monkeypatch.setattr(lsh_forest, "ROOM", room)
    monkeypatch.setattr(lsh_forest, "MAX_BROADCAST_ROWS", most)
    test_forest_against_all_pairs(spark)


def test_forest_of_nothing(spark):
    assert lsh_forest.near_duplicates(docs_of(spark, [])).count() == 0
    alone = lsh_forest.near_duplicates(docs_of(spark, [(1, None), (2, "a b")])).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 1, 2, True)]


def test_ranges_may_end_inside_a_region(spark):
    """Neighbours on either side of a border between tasks meet."""
    rng = random.Random(2)
    base = words(rng, 300)
    rows = docs_of(spark, [(k, " ".join(changed(rng, base, 1))) for k in range(60)])
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        classes = lsh_forest.signatures(rows).withColumnRenamed("doc_id", "row_id")
        pairs = {tuple(r) for r in lsh_forest._ordered_pairs(classes).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    order = {}
    for r in classes.collect():
        order[r.row_id] = lsh_forest._values(pa.array([bytes(r.sig)]))[0]
    for tree in range(lsh_forest.SORTED):
        seq = lsh_forest._SEQUENCE[tree]
        ranked = sorted(order, key=lambda k: (order[k][seq].tolist(), k))
        for a, b in zip(ranked, ranked[1:]):
            near = order[a][seq][: lsh_forest.DEPTH].tolist() == order[b][seq][: lsh_forest.DEPTH].tolist()
            assert not near or (min(a, b), max(a, b)) in pairs
