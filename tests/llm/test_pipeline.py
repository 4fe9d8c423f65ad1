"""The pipeline and the registered queries."""

import random
import zlib

import duckdb
import numpy as np
import plain_versions as plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from threadlake.llm import mixing, queries
from threadlake.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4]
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))


def planted(rng):
    """Documents with a hot source, copies, junk, benchmark passages, nulls."""
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [draw(25) for _ in range(4)]
    texts = []
    for k in range(60):
        base = draw(rng.choice([8, 30, 120]))
        texts.append(" ".join(base))
        if k % 4 == 0:
            texts += [" ".join(base), " ".join([*base, "tail"])]
        if k % 7 == 0:
            texts.append(" ".join(draw(40) + rng.choice(items) + draw(40)))
        if k % 9 == 0:
            texts.append("spam and more spam again " * 12)
    texts += [None, "", "   ", "# " * 50]
    rng.shuffle(texts)
    docs = [(k if k % 11 else None, t, "en", rng.choices(["hot", "b", "c", None], [6, 2, 1, 1])[0], len(t or "")) for k, t in enumerate(texts)]
    return docs, [(k, " ".join(i)) for k, i in enumerate(items)]


def test_run_against_plain(spark, tmp_path):
    docs, items = planted(random.Random(12))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [d for d in docs if plain.passes_quality(d[1])]
    assert len(rows) < len(docs)
    by_group = {}
    for row, (_, group) in zip(rows, plain.groups([d[1] for d in rows])):
        by_group.setdefault(group, []).append(row)
    # which of several rows without an id stays is by reading order: their texts decide nothing below
    kept = [min(group, key=lambda d: (d[0] is None, d[0] or 0)) for group in by_group.values()]
    assert len(kept) < len(rows)
    clean = [d for d, verdict in zip(kept, plain.contamination([d[1] for d in kept], items)) if not verdict[4]]
    assert len(clean) < len(kept)

    stage = dict(corpus_pipeline.STAGES)
    found = spark.createDataFrame(docs, schema)
    for name, want in (("quality", rows), ("near_duplicates", kept), ("decontamination", clean)):
        found = materialize(stage[name](spark, found, str(tmp_path)), f"test-{name}")
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)), name

    frame = spark.createDataFrame(clean, schema)
    keys = [r.k1 & (1 << 64) - 1 for r in frame.select(*mixing.row_keys(frame, "doc_id", "text", "source", 7)).collect()]
    taken = plain.mix([(d[3], len(d[1].split()), k) for d, k in zip(clean, keys)], 4096, mixing.GOLDEN)
    mixed = [d for d, (_, copies, _) in zip(clean, taken) for _ in copies]
    found = stage["mixing"](spark, found, str(tmp_path))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, mixed))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(d[0], np.array(tokenizer.encode(d[1], add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for d in mixed]
    want, at = [], 0
    for key, raw in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((key, len(raw) // 4, zlib.crc32(raw)))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in ("quality", "failed", "h1", "i", "mix_slot", "term_id", "row_id"):
        docs = docs.withColumn(name, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want
