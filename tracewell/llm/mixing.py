"""Mixing sources to target weights by weighted fair queueing.

DataFrame functions only. The documents of a source form a queue in shuffled order, served
``max_repeats`` times over. A copy's virtual finish time is the number of words its source has
served up to and including it, divided by the source's target. All copies are range-sorted by
finish time and the order is cut at the total budget, so at the cut every source has been served
close to its target, whatever the sizes of its documents.

Running totals never gather a source: a source is cut into blocks of its shuffled order, block
totals are carried forward, and each block is finished on its own. The global order is never
gathered either: of the range partitions only the one that holds the cut is looked into.

Defined cases: null or empty text has size 0; a null source is a source of its own, the last one;
repeated rows are separate documents; a source without words has target 0 and nothing is taken
from it; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.base import table, word_count
from tracewell.sources.storage import written

#: Fixed values of the contract: weights by position of the source, share of all words, most copies.
WEIGHTS, SHARE, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: Rows of a block of a source's queue, at most about sixteen times as many.
BLOCK_ROWS = 1024
SOURCE = ["no_source", "source_key"]
OUTPUT = ["doc_id", "size", "source_size", "target", "taken"]


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``target`` for each row of ``sources`` (one row per source: SOURCE, source_size).

    Shares by weight, none above ``max_repeats`` times its source: with the sources ordered by the
    level at which they fill up, a source is full if the level that the rest would reach lies above
    its own. Windows over one row per source.
    """
    named = Window.orderBy(*SOURCE)
    by_level = Window.orderBy("level", *SOURCE)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    index = ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), index)).select(
        "*", (F.col("source_size") * max_repeats).alias("most"), (F.col("source_size") * max_repeats / F.col("weight")).alias("level"),
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows) * F.lit(share)
    reached = weighted.withColumn("reach", (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    open_level = F.min_by(F.when(F.col("level") > F.col("reach"), F.col("reach")), F.when(F.col("level") > F.col("reach"), F.col("level"))).over(all_rows)
    target = F.least(F.col("most").cast("double"), F.coalesce(open_level * F.col("weight"), F.col("most").cast("double")))
    return reached.select(*SOURCE, "source_size", target.alias("target"))


def queue_order(doc_id: Column) -> Column:
    """Shuffles documents the same way in every run."""
    return F.substring(F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256), 1, 16)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): OUTPUT, copies and the text's hash."""
    spark = docs.sparkSession
    narrow = written(docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), queue_order(F.col("doc_id")).alias("place"),
    ), "mix-sizes")
    per_source = narrow.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    largest, budget = per_source.agg(F.max("rows"), F.sum("source_size") * F.lit(share)).first()
    digits = 1
    while (largest or 0) > BLOCK_ROWS * 16 ** digits:
        digits += 1
    blocked = narrow.withColumn("block", F.substring("place", 1, digits))

    forward = Window.partitionBy(*SOURCE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*SOURCE, "block").agg(F.sum("size").alias("block_size")).select(
        *SOURCE, "block", F.coalesce(F.sum("block_size").over(forward), F.lit(0)).alias("before"))
    carried = blocks.join(source_targets(per_source.drop("rows"), weights, share, max_repeats), SOURCE)
    inside = Window.partitionBy(*SOURCE, "block").orderBy("place", "doc_id", "size", "text_hash")
    queued = blocked.join(carried, [*SOURCE, "block"]).select(
        *SOURCE, "block", "place", "doc_id", "size", "text_hash", "source_size", "target", F.row_number().over(inside).alias("position"),
        (F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("served"),
    )
    finish = F.when(F.col("target") > 0, (F.col("round") * F.col("source_size") + F.col("served")) / F.col("target")).otherwise(F.lit(0.0))
    copies = queued.withColumn("round", F.explode(F.array(*map(F.lit, range(max_repeats))))).withColumn("finish", finish)
    order = ["finish", *SOURCE, "place", "doc_id", "text_hash", "position", "round"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(copies.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    full, cut, room = last_part(ranged, budget or 0.0)

    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at_cut = ranged.where(F.col("part") == cut).withColumn("kept", running <= F.lit(room))
    kept = ranged.where(F.col("part") != cut).withColumn("kept", F.col("part") <= full).unionByName(at_cut)
    return kept.groupBy(*SOURCE, "block", "position", "doc_id", "text_hash", "size", "source_size", "target").agg(
        F.sum(F.col("kept").cast("long")).alias("copies")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "text_hash")


def last_part(ranged: DataFrame, budget: float) -> tuple[int, int, float]:
    """The last range partition that fits whole, the one that holds the cut, and the words left for it.

    One row per range partition is summed; only the row at the cut comes to the driver.
    """
    sums = ranged.groupBy("part").agg(F.sum("size").alias("size"))
    up_to = F.sum("size").over(Window.orderBy("part"))
    over = sums.select("part", "size", up_to.alias("up_to")).where(F.col("up_to") > budget).orderBy("part").first()
    if over is None:
        return 2 ** 31 - 1, -1, 0.0
    return over["part"] - 1, over["part"], budget - (over["up_to"] - over["size"])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents that the mix takes, with all their columns and how often each one is taken.

    Rows are matched by id, text hash and their number among equal rows, so repeated rows and
    rows without an id keep their own count. Where ``docs`` has a column of the same name, the added
    one is called ``mix_`` and its name.
    """
    same = Window.partitionBy("mix_id", "mix_hash")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("mix_id"), F.xxhash64("text").alias("mix_hash"))
    counts = mix(docs, weights, share, max_repeats).select(
        F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"), "size", "source_size", "target", "taken")
    a = own.withColumn("mix_row", F.row_number().over(same.orderBy("mix_hash"))).alias("a")
    b = counts.withColumn("mix_row", F.row_number().over(same.orderBy("source_size", "taken"))).alias("b")
    met = a.join(b, F.col("a.mix_id").eqNullSafe(F.col("b.mix_id")) & (F.col("a.mix_hash") == F.col("b.mix_hash")) & (F.col("a.mix_row") == F.col("b.mix_row")))
    added = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in OUTPUT[1:]]
    return met.where("taken > 0").select(*[F.col("doc")[c].alias(c) for c in docs.columns], *added)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(*OUTPUT)


OP8_SQL = r"""
WITH sized AS (
    SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 16) AS place
    FROM documents
), sources AS (
    SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL
), weighted AS (
    SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1)::INT] AS weight FROM sources
), levels AS (
    SELECT *, source_size * 2 AS most, source_size * 2 / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM weighted
), reached AS (
    SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY level, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY level, no_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach
    FROM levels
), targets AS (
    SELECT no_source, source_key, source_size, budget,
           least(most::DOUBLE, coalesce((SELECT arg_min(reach, level) FROM reached WHERE level > reach) * weight, most::DOUBLE)) AS target
    FROM reached
), queued AS (
    SELECT *, sum(size) OVER (PARTITION BY no_source, source_key ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS served
    FROM sized JOIN targets USING (no_source, source_key)
), copies AS (
    SELECT *, CASE WHEN target > 0 THEN (round * source_size + served)::DOUBLE / target ELSE 0 END AS finish
    FROM queued, (VALUES (0), (1)) AS rounds(round)
), cut AS (
    SELECT *, sum(size) OVER (ORDER BY finish, no_source, source_key, place, doc_id, round ROWS UNBOUNDED PRECEDING) <= budget AS kept FROM copies
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (size * sum(kept::INT))::BIGINT AS taken
FROM cut GROUP BY doc_id, size, source_size, target
"""
