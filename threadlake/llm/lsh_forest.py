"""Near duplicates by an LSH forest over MinHash signatures.

A document's set is its distinct five-word shingles (the whole sequence if it has
fewer words); two sets link when 100 * intersection >= 85 * union. A signature is
``HASHES`` MinHash values of 16 bits. A tree is an order of the signatures by
some of their values in a sequence of its own; documents that share the first
``DEPTH`` values of a tree are one region of it.

1. Equal sets form one class (128-bit fingerprints of sets); one member stands
   for it from here on.
2. In ``SORTED`` trees all signatures are sorted over the cluster, and each meets
   its neighbour of longest common prefix. Ranges end anywhere, inside a region
   too, so no region is one task's; the rows at the ends of ranges, two a task,
   meet in a second small pass. Chains of copies become components here.
3. In all ``TREES`` trees, regions that hold several components are open. Their
   members meet the one of them that stands in the largest regions (of a group
   of copies mostly their original), which settles stars.
4. In regions still open members of different components meet, the largest
   component being met and not meeting. What only one of their sets has bounds
   what that one can share (its reach), which drops members of groups that are
   alike but not near enough, and the join itself holds both parities (see
   ``textgrid``) against each other, so that pairs of such groups are not made. Where members would still meet more than
   ``ROOM`` others each, the region is split by the next values of its tree's
   order (depth ``DEPTHS[1]``, then ``DEPTHS[2]``), each piece by itself: crowded
   regions get deep, sparse ones stay shallow. Pieces of the last depth meet in
   full.
5. Every pair is first held against all values of both signatures (linked sets
   agree in 163 of 192 on average, less than ``AGREE`` has odds of 7 * 10^-8) and
   their sizes, and what is left is compared on the full sets of whole texts.

A pair of similarity 0.85 shares no region of depth 5 with odds of 4 * 10^-9, of
depth 7 with 4 * 10^-6, of depth 9 with 2 * 10^-4 (at 0.9: 1 * 10^-12, 4 * 10^-9,
6 * 10^-7). Links of a group support one another, and nothing is capped.

Edge cases: null, empty and blank texts have empty sets, size 0, and stand alone
(component_id is their id, kept true); repeated rows are copies of one another
and each returned; a null id is no candidate for a component's smallest id (null
only if all its ids are) and is kept only then; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import worker
from threadlake.llm.components import components
from threadlake.llm.textgrid import grids, mix, near_by_parities, parities
from threadlake.session import bound_batches, concluded, materialize

HASHES = 192
TREES = 48
SORTED = 3
DEPTHS = (5, 7, 9)
DEPTH = DEPTHS[0]
ROOM = 8
AGREE = 135
MAX_BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240617)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The values that each tree sorts by, in its sequence.
_SEQUENCE = np.stack([_rng.permutation(HASHES)[: DEPTHS[-1]] for _ in range(TREES)])

SIGNATURES = "doc_id long, n long, fp1 long, fp2 long, h1 long, h2 long, sig binary, odd array<bigint>"
PAIRS = "a long, b long, tree int, key binary, row_id long, n long, sig binary"


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and 128 bits of hash of the raw text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))


def _few(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= MAX_BROADCAST_ROWS else rows


def _minhash(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signatures of the sets that begin at ``starts``, none of them empty."""
    made = np.empty((len(starts), HASHES), dtype="<u2")
    for k, factor in enumerate(_FACTORS):
        made[:, k] = mix(np.minimum.reduceat(code * factor, starts)) & np.uint64(0xFFFF)
    return made


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: set size, set fingerprint, hash of the raw text, signature (null of an empty set), parities."""
    names = [part.split()[0] for part in SIGNATURES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            for at, g in grids(batch.column(1), lower=True):
                doc, code = g.shingle_sets()
                n = np.bincount(doc, minlength=g.n_docs)
                ends = np.cumsum(n)
                starts = ends - n
                sums = []
                for salt in (np.uint64(0x51ED270B9F8A3C11), np.uint64(0x2545F4914F6CDD1D)):
                    upto = np.zeros(len(code) + 1, dtype=np.uint64)
                    np.cumsum(mix(code ^ salt), out=upto[1:])
                    sums.append(mix(upto[ends] - upto[starts] + n.astype(np.uint64)).view(np.int64))
                signature: list[bytes | None] = [None] * g.n_docs
                full = np.flatnonzero(n)
                if len(full):
                    for k, row in zip(full, _minhash(code, starts[full])):
                        signature[k] = row.tobytes()
                ids, h1, h2 = (batch.column(c).slice(at, g.n_docs) for c in (0, 2, 3))
                yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), h1, h2, pa.array(signature, pa.binary()), parities(doc, code, g.n_docs)], names)

    bound_batches(docs.sparkSession)
    return _hashed(docs, id_col, text_col).mapInArrow(run, SIGNATURES)


def _values(column: pa.Array) -> np.ndarray:
    """Signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, HASHES)


def _may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and signatures of pairs allow a link."""
    return (100 * np.minimum(n, m) >= 85 * np.maximum(n, m)) & ((x == y).sum(axis=1) >= AGREE)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tree, key, row_id, n, sig) to pairs of neighbours that share
    DEPTH values and may link, and the first and last row of the range."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("row_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])

    def made(size: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in shape], schema=shape)

    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.slice(0, 1) if first is None else first
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        last = batch.slice(batch.num_rows - 1)
        tree, ids, n = (rows.column(c).to_numpy() for c in ("tree", "row_id", "n"))
        key = np.array([k[: 2 * DEPTH] for k in rows.column("key").to_pylist()], dtype=object)
        x = _values(rows.column("sig"))
        at = np.flatnonzero((tree[1:] == tree[:-1]) & (key[1:] == key[:-1]) & _may_link(n[1:], n[:-1], x[1:], x[:-1]))
        yield made(len(at), {"a": pa.array(np.minimum(ids[at], ids[at + 1])), "b": pa.array(np.maximum(ids[at], ids[at + 1]))})
    for end in [first] if first is not None and first.equals(last) else [first, last]:
        if end is not None:
            yield made(1, {c: end.column(c) for c in ("tree", "key", "row_id", "n", "sig")})


def _ordered_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) of neighbours in the sorted trees."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _values(batch.column(2))
            for tree in range(SORTED):
                # high byte first, so that the bytes sort as the values do
                key = [row.tobytes() for row in x[:, _SEQUENCE[tree]].astype(">u2")]
                yield pa.record_batch([pa.array(np.full(len(x), tree, dtype=np.int32)), pa.array(key, pa.binary()), *batch.columns], ["tree", "key", "row_id", "n", "sig"])

    rows = classes.select("row_id", "n", "sig").mapInArrow(keys, "tree int, key binary, row_id long, n long, sig binary")
    order = ["tree", "key", "row_id"]
    met = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, PAIRS), "forest-order")
    ends = met.filter("row_id is not null").select("tree", "key", "row_id", "n", "sig")
    across = ends.repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours, PAIRS)
    return met.select("a", "b").unionByName(across.select("a", "b")).filter("a is not null").distinct()


def _regions(classes: DataFrame) -> DataFrame:
    """row_id, n, label, region and ``path`` per tree: its regions of every depth, as hashes."""

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = mix(np.arange(1, TREES + 1, dtype=np.uint64))
        for batch in batches:
            x = _values(batch.column(2))[:, _SEQUENCE].astype(np.uint64)
            found, state = [], np.broadcast_to(tree, x.shape[:2])
            for depth in range(DEPTHS[-1]):
                state = mix(state ^ (x[:, :, depth] + np.uint64(1)))
                if depth + 1 in DEPTHS:
                    found.append(state.view(np.int64))
            flat = pa.array(np.stack(found, axis=2).reshape(-1))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(DEPTHS), dtype=np.int32)), flat)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, TREES, dtype=np.int32)), inner)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), outer], ["row_id", "n", "label", "paths"])

    made = classes.select("row_id", "n", "sig", "label").mapInArrow(paths, "row_id long, n long, label long, paths array<array<bigint>>")
    return made.select("row_id", "n", "label", F.explode("paths").alias("path")).withColumn("region", F.col("path")[0])


def _with_labels(rows: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links)
    return rows.join(labels.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("label", F.coalesce("label", "row_id"))


def _open(members: DataFrame) -> DataFrame:
    """(region, m) of the regions of several components; a task sends one row a region."""
    return members.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).filter("low < high").select("region", "m")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                keep = _may_link(n, m, _values(batch.column(4)), _values(batch.column(5)))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda s: classes.select(F.col("row_id").alias(s), F.col("n").alias("n" + s), F.col("sig").alias("sig" + s))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(run, "a long, b long")


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, g in grids(texts, lower=True):
        doc, code = g.shingle_sets()
        bounds = np.searchsorted(doc, np.arange(g.n_docs + 1))
        for k in range(g.n_docs):
            yield code[bounds[k] : bounds[k + 1]]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the whole texts of every pair."""
    for batch in batches:
        linked = []
        for x, y in zip(_sets(batch.column("text_a")), _sets(batch.column("text_b"))):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * shared >= 85 * (len(x) + len(y) - shared))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _confirmed(near: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, linked) of written pairs; each text in a pair is fetched once."""
    ends = 2 * near.count()
    if not ends:
        return near.withColumn("linked", F.lit(False))
    wanted = near.select(F.col("a").alias("row_id")).distinct().union(near.select("b").distinct()).distinct()
    texts = materialize(_fetched(wanted, classes, docs, ends), "forest-texts")
    named = lambda s: texts.select(F.col("row_id").alias(s), F.col("text").alias("text_" + s))
    return materialize(near.join(named("b"), "b").join(named("a"), "a").mapInArrow(_compared, "a long, b long, linked boolean"), "forest-compared")


def _fetched(rows: DataFrame, classes: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(row_id, text) of at most ``most`` classes, each once. A row meets the
    class of its own id and text only; repeated rows are one class."""
    keys = classes.select("row_id", F.col("doc_id").alias("id__"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).join(_few(rows, most), "row_id", "left_semi")
    small = _few(keys, most)
    same = (docs["h1"] == small["g1"]) & (docs["h2"] == small["g2"]) & docs["doc_id"].eqNullSafe(small["id__"])
    return docs.join(small, same).select("row_id", "text").dropDuplicates(["row_id"])


def _hopeful(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Members with their parities and their reach, the most that a set can share with any other:
    shingles that no other set in an open region has are shared with none. Those
    that reach less than 85 percent of themselves go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, code in zip(batch.column(0).to_pylist(), _sets(batch.column(1))):
                yield pa.record_batch([pa.array(np.full(len(code), k)), pa.array(code.view(np.int64))], ["row_id", "token"])

    rows = materialize(members.select("row_id").distinct(), "forest-crowd")
    tokens = _fetched(rows, classes, docs, rows.count()).mapInArrow(run, "row_id long, token long")
    alone = tokens.groupBy("token").agg(F.min("row_id").alias("row_id"), F.count("*").alias("k")).filter("k = 1").groupBy("row_id").agg(F.count("*").alias("alone"))
    reach = materialize(alone, "forest-alone")
    known = members.join(_few(reach, reach.count()), "row_id", "left").withColumn("reach", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return materialize(known.filter("100 * reach >= 85 * n").join(classes.select("row_id", "odd"), "row_id"), "forest-hopeful")


def _meetings(members: DataFrame) -> list[DataFrame]:
    """Pairs of members of different components in open regions, crowded ones
    split by their trees' next values."""
    found = []
    may = "100 * least(n, nx) >= 85 * greatest(n, nx) and 185 * least(reach, rx) >= 85 * (n + nx)"
    may += f" and {near_by_parities(85, 'odd', 'n', 'ox', 'nx')}"
    for level in range(len(DEPTHS)):
        at = members.withColumn("region", F.col("path")[level])
        share = at.groupBy("region", "label").agg(F.count("*").alias("k"))
        whole = share.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.sum("k").alias("m"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"))
        apart = (F.col("m").cast("double") * F.col("m") - F.col("squares")) / 2
        crowded = F.lit(False) if level == len(DEPTHS) - 1 else apart > ROOM * F.col("m")
        whole = materialize(whole.filter(apart > 0).select("region", "major", crowded.alias("crowded")), "forest-open")
        regions = whole.count()
        if not regions:
            break
        placed = materialize(at.join(_few(whole, regions), "region"), "forest-placed")
        sparse, members = placed.filter("not crowded"), placed.filter("crowded").drop("crowded", "major")
        minor = sparse.filter("label <> major").select("region", F.col("row_id").alias("x"), F.col("n").alias("nx"), F.col("reach").alias("rx"), F.col("label").alias("label_x"), F.col("odd").alias("ox"))
        meet = minor.join(sparse, "region").filter(f"label <> label_x and (label = major or x < row_id) and {may}")
        found.append(meet.select(F.least("x", "row_id").alias("a"), F.greatest("x", "row_id").alias("b")).distinct())
    return found


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the linked classes of hashed ``docs``."""
    near = materialize(_ordered_pairs(classes), "forest-near")
    links = _confirmed(near, classes, docs).filter("linked").select("a", "b")
    labelled = materialize(_with_labels(classes.select("row_id", "n", "sig"), links), "forest-labelled")
    members = _regions(labelled)
    unsettled = materialize(_open(members), "forest-unsettled")
    count = unsettled.count()
    if not count:
        return components(links)
    members = materialize(members.join(_few(unsettled, count), "region"), "forest-members")
    # Those that stand in the largest regions come first: an original before its copies.
    score = members.groupBy("row_id").agg(F.sum("m").alias("score"))
    scored = members.join(score, "row_id")
    best = scored.groupBy("region").agg(F.max(F.struct("score", "row_id", "n", "label")).alias("best"))
    best = best.select("region", F.col("best.row_id").alias("x"), F.col("best.n").alias("nx"), F.col("best.label").alias("label_x"))
    pair = [F.least("x", "row_id").alias("a"), F.greatest("x", "row_id").alias("b")]
    met = members.join(_few(best, count), "region").filter("label <> label_x and 100 * least(n, nx) >= 85 * greatest(n, nx)").select(*pair).distinct()
    met = materialize(met, "forest-met")
    near = materialize(_agreeing(met, classes), "forest-near")
    links = links.unionByName(_confirmed(near, classes, docs).filter("linked").select("a", "b"))
    again = _with_labels(members.select("row_id", "n", "path", "region"), links)
    again = materialize(again.join(_open(again).select("region"), "region", "left_semi"), "forest-again")
    if not (meetings := _meetings(_hopeful(again, classes, docs))):
        return components(links)
    pairs = meetings[0]
    for more in meetings[1:]:
        pairs = pairs.unionByName(more)
    near = materialize(_agreeing(pairs.distinct().join(met, ["a", "b"], "left_anti"), classes), "forest-near")
    return components(links.unionByName(_confirmed(near, classes, docs).filter("linked").select("a", "b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""

    def build() -> DataFrame:
        rows = materialize(signatures(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "forest-signatures")
        slim = rows.filter("n > 0").select("row_id", "doc_id", "fp1", "fp2")
        first = materialize(slim.groupBy("fp1", "fp2").agg(F.min("row_id").alias("class"), F.min("doc_id").alias("least_id"), F.count("*").alias("k")), "forest-classes")
        copies = first.filter("k > 1")
        same = materialize(slim.join(copies, ["fp1", "fp2"]).filter("row_id <> class").select("row_id", "class"), "forest-same")
        classes = rows.filter("n > 0").join(same.select("row_id"), "row_id", "left_anti")
        labels = link_classes(_hashed(docs, id_col, text_col), classes).withColumnRenamed("node", "class")
        least = labels.join(first.select("class", "least_id"), "class").groupBy("label").agg(F.min("least_id").alias("component_id"))
        linked = labels.join(least, "label").select("class", "component_id")
        component = first.select("class", "least_id").join(linked, "class", "left").select("class", F.coalesce("component_id", "least_id").alias("component_id"))
        member = rows.select("row_id", "doc_id", "n").join(same, "row_id", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("class", "row_id")))
        found = member.join(component, "class", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    return concluded(docs.sparkSession, "forest-groups", build)


def op13_lsh_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM t WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
