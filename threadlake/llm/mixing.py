"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled (by a seeded hash of the id) and laid end
to end as one stream of words, cut into blocks of ``block_words``. The schedule
has one slot per block to be taken. Slot ``j`` owns the golden-ratio point
``frac(j * phi)``, which is mapped through the cumulative slot weights of the
sources; the slots of a source are ranked, and its ``k``-th slot takes its block
``k mod n_blocks``. A stream is thus read around as often as its target asks.
Blocks and slots are joined: what a document contributes, and where in the mix
it comes first, is read off the slots that take its blocks.

Scale: the only per-source windows run over a row per source or over
pre-aggregated (source, bucket) rows; documents and slots are ranked inside
hash buckets whose number follows the row count, so a source that holds a third
of all rows is spread over as many tasks as its share needs.

Edge cases: a null text or one without words has size 0 and is never taken; a
null source is a source of its own and sorts last; the place of a row follows
from the hash of its id and text, so null and repeated ids are spread like any
other; repeated rows are separate documents of the stream; an empty table gives
an empty result; extra columns are ignored by ``mix`` and kept, whatever their
names, by ``mixed_documents``.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import concluded, materialize

GOLDEN = 0.6180339887498949
WEIGHT_CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 2048
SLOTS_PER_CHUNK = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weight_cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> rank, weight and target of each source.

    Target = min(max_epochs * size, weight * level) where the level makes the
    targets add up to the sum of all sizes. Sources sorted by cap / weight hit
    their cap in that order, so the level has a closed form over the sorted rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weight_cycle])
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(cycle, F.col("source_rank") % len(weight_cycle))
    )
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    by_fill = Window.orderBy("full_at", "source_rank")
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level_here", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn(
            "level",
            F.min(F.when(F.col("level_here") <= F.col("full_at"), F.struct("full_at", "source_rank", "level_here")))
            .over(Window.partitionBy())
            .getField("level_here"),
        )
    )
    return filled.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("level"))).select(
        "source", "source_rank", "source_size", "weight", "target"
    )


def _slot_plan(targets: DataFrame, block_words: int, max_epochs: int) -> DataFrame:
    """Words and slots each source takes, and its range in the cumulative slot weights."""
    s, b = F.col("source_size"), F.lit(block_words)
    words = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.lit(max_epochs) * s)
    planned = (
        targets.withColumn("take", words)
        .withColumn("blocks", F.ceil(s / b).cast("long"))
        .withColumn(
            "slots",
            F.when(s > 0, F.expr("take div source_size") * F.col("blocks") + F.ceil(F.expr("take % source_size") / b)).otherwise(F.lit(0)).cast("long"),
        )
    )
    upto = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    return planned.withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.col("hi") - F.col("slots"))


def schedule(plan: DataFrame, total_slots: int, n_sources: int) -> DataFrame:
    """slot_no, source_rank, rank_in_source of every slot of the mix, in reading order.

    Points reach their source by an equi-join on range buckets (each source
    range is listed under the buckets it touches). The points of a source miss
    its exact slot count by a few; surplus slots go, missing ones follow at the end.
    """
    spark = plan.sparkSession
    width = max(1, total_slots // max(1, n_sources))
    ranges = plan.filter("slots > 0").select(
        "source_rank", "slots", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("bucket")
    )
    point = (F.col("id") + 1).cast("double") * F.lit(GOLDEN)
    at = F.least(F.floor((point - F.floor(point)) * total_slots).cast("long"), F.lit(total_slots - 1))
    points = spark.range(total_slots).select(F.col("id").alias("slot_no"), at.alias("at")).withColumn("bucket", F.expr(f"at div {width}"))
    dealt = (
        points.join(ranges, "bucket")
        .filter("at >= lo and at < hi")
        .select("slot_no", "source_rank", F.expr(f"slot_no div {SLOTS_PER_CHUNK}").alias("chunk"))
    )
    before = Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        dealt.groupBy("source_rank", "chunk").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    inside = Window.partitionBy("source_rank", "chunk").orderBy("slot_no")
    ranked = (
        dealt.withColumn("r", F.row_number().over(inside) - 1)
        .join(chunks.select("source_rank", "chunk", "base"), ["source_rank", "chunk"])
        .join(plan.select("source_rank", "slots"), "source_rank")
        .withColumn("rank_in_source", F.col("base") + F.col("r"))
        .filter("rank_in_source < slots")
        .select("slot_no", "source_rank", "rank_in_source")
    )
    got = chunks.groupBy("source_rank").agg(F.sum("n").alias("got"))
    missing = (
        plan.join(got, "source_rank", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("got < slots")
        .select((F.lit(total_slots) + F.col("lo")).alias("base"), "source_rank", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank_in_source"))
        .select((F.col("base") + F.col("rank_in_source")).alias("slot_no"), "source_rank", "rank_in_source")
    )
    return ranked.unionByName(missing)


def row_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """Two 64-bit hashes of a row's id, text and source."""
    parts = [F.col(c).cast("string") for c in (id_col, text_col, source_col)]
    return [F.xxhash64(F.lit(salt), *parts, *(p.isNull() for p in parts)).alias(k) for k, salt in (("k1", seed), ("k2", seed + 1))]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 4096,
    seed: int = 7,
    weight_cycle=WEIGHT_CYCLE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken,
    stream_start, first_slot and n_slots (the slots that take a block of it),
    copy_slots (the slots in which its first word is taken) and the row's two
    keys, k1 and k2, the first of which orders the stream."""
    text = F.col(text_col).cast("string")
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            *row_keys(docs, id_col, text_col, source_col, seed),
        ),
        "mix-sizes",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = materialize(_slot_plan(source_targets(sizes.select("source", "source_size"), weight_cycle, max_epochs), block_words, max_epochs), "mix-plan")
    total_slots, n_sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    n_docs = slim.count()

    # The stream position of every document: bucket sums first, then inside the bucket.
    bits = max(1, min(40, ceil(log2(max(2, n_docs / ROWS_PER_BUCKET)))))
    placed = slim.join(
        plan.select(F.col("source").alias("s"), "source_rank", "source_size", "target", "take"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    placed = placed.withColumn("bucket", F.shiftrightunsigned("k1", 64 - bits))
    before = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("source_rank", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    )
    about = ["doc_id", "source", "size", "source_size", "target", "stream_start", "k1", "k2"]
    inside = Window.partitionBy("source_rank", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    streamed = (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(bases, ["source_rank", "bucket"])
        .withColumn("stream_start", F.col("base") + F.col("upto") - F.col("size"))
        .select(*about, "source_rank", F.monotonically_increasing_id().alias("row"))
    )
    streamed = materialize(streamed, "mix-streamed")
    none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_slots": F.lit(0).cast("long"), "copy_slots": F.array().cast("array<bigint>")}
    idle = streamed.filter("size = 0").select(*about, *(c.alias(k) for k, c in none.items()))
    if not total_slots:
        return idle

    # The slots of each block, and how much of it the last, partial slot takes.
    facts = plan.select("source_rank", "blocks", "take", F.col("source_size").alias("stream"))
    blocks = (
        schedule(plan, total_slots, n_sources)
        .join(facts, "source_rank")
        .withColumn("block", F.expr("rank_in_source % blocks"))
        .withColumn("length", F.least(F.lit(block_words), F.col("stream") - F.col("block") * block_words))
        .withColumn("words", F.least("length", F.col("take") - F.expr("rank_in_source div blocks") * F.col("stream") - F.col("block") * block_words))
        .groupBy("source_rank", "block")  # max_epochs and one more slots at most
        .agg(
            F.count_if(F.col("words") >= F.col("length")).alias("times"),
            F.max(F.when(F.col("words") < F.col("length"), F.col("words")).otherwise(0)).alias("partial"),
            F.array_sort(F.collect_list("slot_no")).alias("slots"),
        )
    )
    parts = streamed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"stream_start div {block_words}"), F.expr(f"(stream_start + size - 1) div {block_words}")))
    )
    begin = F.col("block") * block_words
    left = F.greatest("stream_start", begin)
    right = F.least(F.col("stream_start") + F.col("size"), begin + block_words)
    cut = F.greatest(F.lit(0), F.least(right, begin + F.col("partial")) - left)
    whole = F.col("slots").isNotNull() & (cut <= 0) & (F.col("times") < F.size("slots"))
    mine = F.when(whole, F.slice("slots", 1, F.greatest(F.lit(1), F.col("times")))).otherwise(F.col("slots"))
    busy = (
        parts.join(blocks, ["source_rank", "block"], "left")
        .withColumn("got", F.coalesce((right - left) * F.col("times") + cut, F.lit(0)))
        .withColumn("mine", F.when(F.col("got") > 0, mine))
        .groupBy("row", *about)
        .agg(
            F.sum("got").alias("taken"),
            F.min(F.col("mine")[0]).alias("first_slot"),
            F.sum(F.when(F.col("got") > 0, F.size("mine")).otherwise(0)).alias("n_slots"),
            F.coalesce(F.min_by("mine", "block"), F.array().cast("array<bigint>")).alias("copy_slots"),
        )
        .drop("row")
    )
    return busy.unionByName(idle)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of the given ones has, in either case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """The documents as the mix takes them, columns kept: a document goes if no
    word of it is taken and stands once for every slot in which its first word
    is; the one document per source that the target cuts is kept whole.

    Texts are shuffled once, by the row's keys; each partition is then put in
    slot order, so every file of the result is interleaved as the schedule says.
    Rows equal in id, text and source take turns.
    """

    def build() -> DataFrame:
        equal = Window.partitionBy("k1", "k2")
        taken = mix(docs, id_col, text_col, source_col, seed=seed, **options).withColumn("times", F.count("*").over(equal)).filter("taken > 0")
        return taken.select("k1", "k2", "copy_slots", "times", F.row_number().over(equal.orderBy("copy_slots")).alias("turn"))

    names = [fresh(f"mix_{name}", docs.columns) for name in ("k1", "k2", "slots", "times", "turn", "h1", "h2", "place", "slot")]
    k1, k2, slots, times, turn, h1, h2, place, slot = names
    plan = concluded(docs.sparkSession, "mix-taken", build).toDF(*names[:5])
    rows = docs.withColumns(dict(zip((h1, h2), row_keys(docs, id_col, text_col, source_col, seed))))
    same = (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2))

    def placed(joined: DataFrame) -> DataFrame:
        return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(slots).alias(slot)).sortWithinPartitions(slot).drop(slot)

    found = placed(rows.join(plan.filter(F.col(times) == 1).hint("merge"), same))
    several = plan.filter(F.col(times) > 1)
    if several.isEmpty():
        return found
    equal = rows.join(several.select(k1, k2).distinct(), same, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(h1, h2).orderBy(F.lit(0))))
    return found.unionByName(placed(equal.join(several, same & (F.col(place) == F.col(turn)))))


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots")
