"""Large groups that are alike but not near enough: members meet, few make pairs."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from threadlake.llm import jaccard, lsh_forest, textgrid


def alike(seed: int, copies: int = 90) -> list[str]:
    """Copies of one text with five of thirty changes each, some with one; the
    new words are the same in all copies, so no shingle is a copy's own."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(copies):
        copy = list(base)
        for at in rng.sample(range(2, 150, 5), 1 if k % 30 == 0 else 5):
            copy[at] = f"z{at}"
        texts.append(" ".join(copy))
    return texts


def groups(texts: list[str], percent: int) -> list[int]:
    """Smallest text that each reaches by links."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_alike_but_apart_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "ROOM", 0)
    texts, made, keep = alike(3), [], jaccard.materialize

    def counted(df, label, *more):
        table = keep(df, label, *more)
        if label == "jaccard-pairs":
            made.append(table.count())
        return table

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = {r.doc_id: r.component_id for r in jaccard.group(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts, 80)
    assert len(made) == 2 and made[1] < 2 * len(texts)


def test_alike_but_apart_forest(spark, monkeypatch):
    texts, made, keep = alike(4), [], lsh_forest._meetings

    def counted(members):
        found = keep(members)
        made.append(sum(df.count() for df in found))
        return found

    monkeypatch.setattr(lsh_forest, "_meetings", counted)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts, 85)
    assert made and made[0] < 2 * len(texts)


@pytest.mark.parametrize("percent", [80, 85])
def test_parities_drop_no_link(spark, percent):
    texts = alike(5, 40) + ["a b", "", "a b c d e f", " ".join(f"v{k}" for k in range(3000)), " ".join(f"v{k}" for k in range(200, 3000))]
    rows, sets = [], []
    for at, g in textgrid.grids(pa.array(texts), lower=True):
        doc, code = g.shingle_sets()
        odd = textgrid.parities(doc, code, g.n_docs).to_pylist()
        sets += [set(code[doc == k].tolist()) for k in range(g.n_docs)]
        rows += [(at + k, int((doc == k).sum()), odd[k]) for k in range(g.n_docs)]
    spark.createDataFrame(rows, "id int, n int, odd array<bigint>").createOrReplaceTempView("parity_rows")
    may = textgrid.near_by_parities(percent, "x.odd", "x.n", "y.odd", "y.n")
    passed = {tuple(r) for r in spark.sql(f"select x.id, y.id from parity_rows x join parity_rows y on x.id < y.id and {may}").collect()}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert linked and linked <= passed
