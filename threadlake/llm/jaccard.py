"""Jaccard self-join of shingle sets by several global orders.

A document's set is its distinct five-word shingles (the whole sequence if it
has fewer words). Two sets link when 100 * intersection >= 80 * union. Under any
order of all shingles, linked sets share one of their first
``floor(0.2 n) + 1`` members; how many they share there bounds how many they can
share at all. Candidates come from one order's index and must then pass that
bound under further orders before their texts are fetched and compared.

1. Equal sets form one class (128-bit fingerprints of sets); one member stands
   for it from here on.
2. First index: every class lists its shingles whose hash is below ``THETA`` of
   the range, the start of the order "by hash". Shingles of one class drop out.
   A shingle of more than ``HOT`` classes is hot and goes to the end of the
   order, so boilerplate never makes pairs. A class with enough cold listed
   shingles for its prefix is safe: whatever links to it shares one of them.
3. Second index, only among the other (short or boilerplate-ridden) classes:
   all their shingles in order of exact frequency, rarest first, cut to prefixes.
4. In every list of an index all members meet the one that shares most with
   others (of a group of copies mostly their original). Found links are joined
   to components; lists within one component are done. What is left meets
   across components. In crowded lists, of more than ``ROOM`` meetings per
   listing, a meeting is first held against the parities of both sets, within
   the join, so members that are alike but not near enough make no pair; beyond
   ``HELD`` such comparisons per listing further rounds with twice the meeting
   members come before. No link between different components is missed. When all meet, the number of lists a pair shares is
   known in full and bounds its intersection, which drops most pairs at once.
   Shingles of a single class count towards no intersection, which bounds what a
   set can share at all (its reach) and takes hopeless members off the lists;
   two sets compared with the same third are bounded by what they share with it.
5. Pairs are first held against two more orders (hash descending; a second
   hash), whose prefixes every class carries as 16-bit values: equal values may
   be different shingles, which lets pairs pass but never drops one.
6. Remaining pairs are compared on the full sets of their whole texts.

Edge cases: null, empty and blank texts have empty sets, size 0, and stand
alone; repeated rows are copies of one another and each returned; a null id is
no candidate for a component's smallest id (null only if all its ids are); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm import worker
from threadlake.llm.components import components
from threadlake.llm.textgrid import grids, mix, near_by_parities, parities
from threadlake.session import bound_batches, concluded, materialize

THETA = np.uint64((1 << 64) // 100 * 26)
HOT = 64
ROOM = 32
HELD = 4096
MAX_BROADCAST_IDS = 1_000_000
_SECOND_ORDER = np.uint64(0xD6E8FEB86659FD93)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Members of a set of n that cannot all be missing from a linked set."""
    return n - (80 * n + 99) // 100 + 1


def _list_of(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]), values


def _tails(starts: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the last ``size`` entries of every range."""
    keep = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    np.add.at(keep, ends - size, 1)
    np.add.at(keep, ends, -1)
    return np.flatnonzero(np.cumsum(keep[:-1]) > 0)


def _binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    raw = values.astype("<u2").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 2).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


SIGNATURES = "doc_id long, n long, fp1 long, fp2 long, h1 long, h2 long, second binary, third binary, listed array<bigint>, odd array<bigint>"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: set size, set fingerprint, hash of the raw text, prefixes under
    the second and third order, the shingles listed in the first index, parities."""
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
                size = np.where(n > 0, prefix_size(n), 0)
                offsets = np.concatenate([[0], np.cumsum(size)])
                second = _binary(offsets, code[_tails(starts, ends, size)] & np.uint64(0xFFFF))
                other = mix(code ^ _SECOND_ORDER)
                other = other[np.lexsort((other, doc))]
                third = _binary(offsets, other[_tails(starts, ends, size)] & np.uint64(0xFFFF))
                low = code < THETA
                where, values = _list_of(doc[low], code[low].view(np.int64), g.n_docs)
                listed = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(values, pa.int64()))
                ids, h1, h2 = (batch.column(c).slice(at, g.n_docs) for c in (0, 2, 3))
                yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), h1, h2, second, third, listed, parities(doc, code, g.n_docs)], names)

    bound_batches(docs.sparkSession)
    return _hashed(docs, id_col, text_col).mapInArrow(run, SIGNATURES)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and 128 bits of hash of the raw text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))


def _few(rows: DataFrame, at_most: int | None = None) -> DataFrame:
    """A table of a few longs a row, broadcast if its rows, counted or known to
    be at most so many, are few enough."""
    return F.broadcast(rows) if (rows.count() if at_most is None else at_most) <= MAX_BROADCAST_IDS else rows


def _texts(docs: DataFrame, wanted: DataFrame, at_most: int | None = None) -> DataFrame:
    """(row_id, text) of the wanted (row_id, doc_id, h1, h2), each once. ``docs``
    are hashed: a row meets the wanted one of its own id and text only. One
    class has one wanted row, so none but repeated rows meet the same; they are
    told apart by id and hashes before any text moves."""
    small = _few(wanted.select("row_id", F.col("doc_id").alias("id__"), F.col("h1").alias("g1"), F.col("h2").alias("g2")), at_most)
    same = (docs["h1"] == small["g1"]) & (docs["h2"] == small["g2"]) & docs["doc_id"].eqNullSafe(small["id__"])
    return docs.join(small, same).select("row_id", "text").dropDuplicates(["row_id"])


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, g in grids(texts, lower=True):
        doc, code = g.shingle_sets()
        bounds = np.searchsorted(doc, np.arange(g.n_docs + 1))
        for k in range(g.n_docs):
            yield code[bounds[k] : bounds[k + 1]]


def _frequency_index(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """(token, row_id, df, reach): prefixes under exact frequency among the given
    classes; reach counts the members that another of these classes has too.
    Members of a single class come first in the order and are no candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for k, code in enumerate(_sets(batch.column(1))):
                yield pa.record_batch([pa.array(np.full(len(code), rows[k])), pa.array(code.view(np.int64)), pa.array(np.full(len(code), len(code)))], ["row_id", "token", "n"])

    tokens = materialize(_texts(docs, rest).mapInArrow(run, "row_id long, token long, n long"), "jaccard-tokens")
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "jaccard-shared")
    own = Window.partitionBy("row_id")
    place = F.row_number().over(own.orderBy("df", "token"))
    held = tokens.join(shared, "token").withColumn("place", place).withColumn("reach", F.count("*").over(own))
    return held.filter("place + n - reach <= n - floor((80 * n + 99) / 100) + 1").select("token", "row_id", "df", "reach")


def _passes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose prefixes under the further orders share enough."""
    for batch in batches:
        cols = batch.to_pydict()
        keep = []
        for k in range(batch.num_rows):
            na, nb = cols["na"][k], cols["nb"][k]
            outside = max(na - prefix_size(na), nb - prefix_size(nb))
            ok = True
            for name in ("second", "third"):
                x, cx = np.unique(np.frombuffer(cols[name + "_a"][k], dtype="<u2"), return_counts=True)
                y, cy = np.unique(np.frombuffer(cols[name + "_b"][k], dtype="<u2"), return_counts=True)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                shared = int(np.minimum(cx[i], cy[j]).sum())
                if 180 * (shared + outside) < 80 * (na + nb):
                    ok = False
                    break
            keep.append(ok)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _same_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersections of the full sets."""
    for batch in batches:
        left, right = _sets(batch.column("text_a")), _sets(batch.column("text_b"))
        common, linked = [], []
        for x, y in zip(left, right):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            common.append(shared)
            linked.append(100 * shared >= 80 * (len(x) + len(y) - shared))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "shared", "linked"])


def _within_bounds(counted: DataFrame, shape: DataFrame) -> DataFrame:
    """Pairs whose full counts of shared listings allow a link.

    In the first index both sets list all their cold members below the same
    hash, so what they share elsewhere is at most what either has elsewhere. In
    the second the shorter prefix in frequency order bounds it likewise.
    """
    size = lambda s: shape.select(F.col("row_id").alias(s), F.col("n").alias("n" + s), F.col("cold").alias("c" + s))
    tail = lambda s: F.floor((80 * F.col("n" + s) + 99) / 100) - 1
    needed = 80 * (F.col("na") + F.col("nb"))
    first = 180 * (F.col("shared1") + F.least(F.col("na") - F.col("ca"), F.col("nb") - F.col("cb"))) >= needed
    second = (F.col("shared2") == 0) | (180 * (F.col("shared2") + F.greatest(tail("a"), tail("b"))) >= needed)
    return counted.join(size("a"), "a").join(size("b"), "b").filter(first & second).select("a", "b")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, shared, linked) of the pairs that pass orders two and three. The
    prefixes of the classes that are in a pair are cut out first."""
    rows = lambda of: of.select(F.col("a").alias("row_id")).union(of.select("b")).distinct()
    info = classes.select("row_id", "doc_id", "h1", "h2", "n", "second", "third").join(_few(rows(pairs), 2 * pairs.count()), "row_id", "left_semi")
    info = materialize(info, "jaccard-prefixes")
    side = lambda s: info.select(F.col("row_id").alias(s), F.col("n").alias("n" + s), F.col("second").alias("second_" + s), F.col("third").alias("third_" + s))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter("100 * least(na, nb) >= 80 * greatest(na, nb)")
    near = materialize(sized.mapInArrow(_passes, "a long, b long"), "jaccard-near")
    ends = 2 * near.count()
    wanted = info.select("row_id", "doc_id", "h1", "h2").join(_few(rows(near), ends), "row_id", "left_semi")
    texts = materialize(_texts(docs, wanted, ends), "jaccard-texts")
    named = lambda s: texts.select(F.col("row_id").alias(s), F.col("text").alias("text_" + s))
    return materialize(near.join(named("b"), "b").join(named("a"), "a").mapInArrow(_same_sets, "a long, b long, shared long, linked boolean"), "jaccard-compared")


def _centers(compared: DataFrame, allowed: DataFrame) -> DataFrame:
    """(row_id, center, common): of the allowed sets that each set was compared
    with, the one that most were compared with, and what they share."""
    both = compared.select(F.col("a").alias("row_id"), F.col("b").alias("center"), F.col("shared").alias("common"))
    both = both.unionByName(compared.select(F.col("b").alias("row_id"), F.col("a").alias("center"), F.col("shared").alias("common")))
    degree = both.groupBy("center").agg(F.count("*").alias("degree")).join(allowed.select(F.col("row_id").alias("center")), "center", "left_semi")
    best = both.join(degree, "center").groupBy("row_id").agg(F.max_by(F.struct("center", "common"), F.struct("degree", "center")).alias("best"))
    return best.select("row_id", "best.center", "best.common")


def _first_index(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, row_id, df) of the cold listed shingles that several classes have,
    (row_id, hot) of the classes with hot ones).

    No task sees more than HOT + 1 rows of a shingle per task that sends it.
    """
    listed = classes.select("row_id", F.explode("listed").alias("token"))
    place = F.row_number().over(Window.partitionBy("token").orderBy("row_id"))
    seen = listed.withColumn("place", place).filter(F.col("place") <= HOT + 1).withColumn("df", F.count("*").over(Window.partitionBy("token")))
    seen = materialize(seen.filter("df > 1").drop("place"), "jaccard-listing")
    hot = seen.filter(F.col("df") > HOT)
    known = hot.count() // (HOT + 1)
    return seen.filter(F.col("df") <= HOT), listed.join(_few(hot.select("token").distinct(), known), "token").groupBy("row_id").agg(F.count("*").alias("hot"))


def _hopeful(lists: DataFrame) -> DataFrame:
    """Drop members that no set of a size near theirs can link to, by their reach."""
    return lists.filter("180 * reach >= 80 * (n + floor((80 * n + 99) / 100))")


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the linked classes of hashed ``docs``."""
    cold, hot = _first_index(classes)
    # reach: the most that any other set can share; single shingles are shared with none
    shape = (
        classes.filter("n > 0")
        .select("row_id", "doc_id", "h1", "h2", "n", F.size("listed").alias("found"))
        .join(cold.groupBy("row_id").agg(F.count("*").alias("held")), "row_id", "left")
        .join(hot, "row_id", "left")
        .na.fill(0, ["held", "hot"])
        .withColumn("cold", F.col("found") - F.col("hot"))
        .withColumn("reach", F.col("n") - F.col("found") + F.col("held") + F.col("hot"))
        .drop("found", "hot", "held")
    )
    shape = materialize(shape, "jaccard-shape")
    unsafe = shape.filter("cold < n - floor((80 * n + 99) / 100) + 1 and 100 * reach >= 80 * n").select("row_id", "doc_id", "h1", "h2")
    rest = _frequency_index(docs, unsafe)
    key = lambda k: F.struct(F.lit(k).alias("index"), F.col("token").alias("token")).alias("list")
    lists = cold.select(key(1), "row_id", "df", F.lit(None).cast("long").alias("seen")).unionByName(rest.select(key(2), "row_id", "df", F.col("reach").alias("seen")))
    lists = lists.join(shape.select("row_id", "n", "reach"), "row_id").withColumn("reach", F.least("reach", "seen")).drop("seen")
    # Members that share most with most others come first: an original before its copies.
    score = F.sum("df").over(Window.partitionBy("row_id"))
    lists = materialize(_hopeful(lists).withColumn("score", score).drop("df"), "jaccard-lists")

    size = lambda of: [F.col(of).alias("x"), F.col("n").alias("nx"), F.col("reach").alias("rx")]
    may = "row_id <> x and 100 * least(n, nx) >= 80 * greatest(n, nx) and 180 * least(reach, rx) >= 80 * (n + nx)"
    pair = [F.least("x", "row_id").alias("a"), F.greatest("x", "row_id").alias("b")]
    best = F.max(F.struct("score", "row_id", "n", "reach")).alias("best")
    firsts = materialize(lists.groupBy("list").agg(best, F.count("*").alias("m")).filter("m > 1").select("list", "best.*"), "jaccard-firsts")
    pairs = lists.join(firsts.select("list", *size("row_id")), "list").filter(may).select(*pair).distinct()
    compared = _verify(materialize(pairs, "jaccard-pairs"), classes, docs)
    links = compared.filter("linked").select("a", "b")
    lists = lists.join(_centers(compared, unsafe), "row_id", "left")
    # With a center c, x and y share min(|x & c|, |y & c|) inside it at most, and
    # outside it no more than either reaches there.
    may += " and (center is null or cx is null or center <> cx or 180 * (least(common, sx) + least(reach - common, rx - sx)) >= 80 * (n + nx))"
    other = [*size("row_id"), F.col("center").alias("cx"), F.col("common").alias("sx")]
    met, meeting = firsts.select("list", "row_id"), 1
    while True:
        labels = components(links)
        # Those that met everyone leave; lists within one component are done. In
        # the others all members but those of the largest component are minor.
        later = lists.join(met, ["list", "row_id"], "left_anti")
        labelled = later.join(labels.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("label", F.coalesce("label", "row_id"))
        labelled = materialize(labelled, "jaccard-labelled")
        share = labelled.groupBy("list", "label").agg(F.count("*").alias("k"))
        whole = share.groupBy("list").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("squares"))
        whole = whole.filter("m * m > squares").withColumn("apart", F.expr("(double(m) * m - squares) / 2"))
        whole = materialize(whole.withColumn("crowded", F.col("apart") > ROOM * F.col("m")), "jaccard-whole")
        rows, crowded, apart = whole.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("crowded"), F.col("m"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("crowded"), F.col("apart"))), F.lit(0.0))).first()
        if not rows:
            return labels
        lists = materialize(labelled.join(whole.select("list", "major", "crowded"), "list"), "jaccard-lists")
        crowd = lists.filter("crowded")
        if crowded:
            crowd = materialize(crowd.join(classes.select("row_id", "odd"), "row_id"), "jaccard-crowd")
        held = f"{may} and {near_by_parities(80, 'odd', 'n', 'ox', 'nx')}"
        if apart <= HELD * crowded + 1_000_000:
            met_by = lambda of, *more: of.filter("label <> major").select("list", *other, F.col("label").alias("label_x"), *more)
            across = "label <> label_x and (label = major or x < row_id)"
            each = ["list", *pair]
            sparse = lists.filter("not crowded")
            every = met_by(sparse).join(sparse, "list").filter(f"{across} and {may}").select(*each)
            if crowded:
                every = every.unionByName(met_by(crowd, F.col("odd").alias("ox")).join(crowd, "list").filter(f"{across} and {held}").select(*each))
            counted = every.groupBy("a", "b").agg(F.count_if(F.col("list.index") == 1).alias("shared1"), F.count_if(F.col("list.index") == 2).alias("shared2"))
            # A pair not yet compared that may link meets in every list it shares, so its counts are full.
            pairs = materialize(_within_bounds(counted, shape), "jaccard-pairs")
            compared = _verify(pairs, classes, docs)
            return components(links.unionByName(compared.filter("linked").select("a", "b")))
        meeting *= 2
        top = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), F.desc("row_id")))
        firsts = materialize(crowd.withColumn("place", top).filter(F.col("place") <= meeting).drop("place"), "jaccard-firsts")
        seen = firsts.select("list", *other, F.col("label").alias("label_x"), F.col("odd").alias("ox"))
        pairs = crowd.join(seen, "list").filter(f"label <> label_x and {held}").select(*pair).distinct()
        compared = _verify(materialize(pairs, "jaccard-pairs"), classes, docs)
        links = links.unionByName(compared.filter("linked").select("a", "b"))
        lists, met = lists.drop("label", "major", "crowded"), firsts.select("list", "row_id")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(signatures with row_id, (class, component, component_id) of every class).

    Ids and components are settled over classes, by sums made before the
    shuffle; rows meet them by plain joins, which adaptive execution splits.
    """
    rows = materialize(signatures(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "jaccard-signatures")
    slim = rows.filter("n > 0").select("row_id", "doc_id", "fp1", "fp2")
    first = materialize(slim.groupBy("fp1", "fp2").agg(F.min("row_id").alias("class"), F.min("doc_id").alias("least_id"), F.count("*").alias("k")), "jaccard-classes")
    same = materialize(slim.join(first.filter("k > 1"), ["fp1", "fp2"]).filter("row_id <> class").select("row_id", "class"), "jaccard-same")
    classes = rows.join(_few(same.select("row_id")), "row_id", "left_anti")
    labels = link_classes(_hashed(docs, id_col, text_col), classes)
    labels = labels.withColumnRenamed("node", "class")
    least = materialize(labels.join(first.select("class", "least_id"), "class").groupBy("label").agg(F.min("least_id").alias("component_id")), "jaccard-least")
    component = labels.join(least, "label").select("class", F.col("label").alias("component"), "component_id")
    alone = first.join(labels.select("class"), "class", "left_anti").select("class", F.col("class").alias("component"), F.col("least_id").alias("component_id"))
    component = component.unionByName(alone)
    member = rows.select("row_id", "doc_id", "n", "h1", "h2").join(same, "row_id", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("class", "row_id")))
    return member, component


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""

    def build() -> DataFrame:
        member, component = _placed(docs, id_col, text_col)
        found = member.join(component, "class", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")

    return concluded(docs.sparkSession, "jaccard-groups", build)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: that of smallest id (null
    last), the first in reading order among equal ids. Rows without words stay.

    Texts meet the chosen (id, hashes of the text) in one shuffle at every size.
    Of rows equal in id and text that are chosen, one stays.
    """

    def build() -> DataFrame:
        member, component = _placed(docs, id_col, text_col)
        worded = member.filter("n > 0").join(component.select("class", "component"), "class")
        order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_id", "h1", "h2")
        chosen = worded.groupBy("component").agg(F.min(order).alias("one")).select("one.doc_id", "one.h1", "one.h2")
        times = worded.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").withColumnsRenamed({"doc_id": "i", "h1": "g1", "h2": "g2"})
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
        chosen = chosen.join(times, same, "left").select("doc_id", "h1", "h2", F.col("times").isNotNull().alias("repeated"))
        empty = member.filter("n = 0").select("doc_id", "h1", "h2", F.lit(False).alias("repeated")).distinct()
        return chosen.unionByName(empty)

    keep = concluded(docs.sparkSession, "jaccard-kept", build).withColumnsRenamed({"doc_id": "i", "h1": "g1", "h2": "g2"})
    text = docs[text_col].cast("string")
    same = docs[id_col].cast("long").eqNullSafe(keep["i"]) & (F.xxhash64(text) == keep["g1"]) & (F.xxhash64(F.lit("second"), text) == keep["g2"])
    once = docs.join(keep.filter("not repeated").hint("merge"), same, "left_semi")
    if keep.filter("repeated").isEmpty():
        return once
    return once.unionByName(docs.join(keep.filter("repeated"), same, "left_semi").dropDuplicates([id_col, text_col]))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM t WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
