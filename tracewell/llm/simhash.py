"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; texts are linked where theirs differ in at most two. Cut into four blocks
of 16 bits, two such fingerprints share two whole blocks at least, so all fingerprints meet others
under each of the six pairs of blocks, and the Hamming distance of those that meet is verified.

Equal fingerprints are one row from the start, so copies cost nothing more. A pair of blocks that
over ``CROWD`` different fingerprints share is not joined with itself: its fingerprints meet at
midpoints instead. Two fingerprints at distance two or less both lie within one bit of a common
value, and all that lie within one bit of a value are links of each other; the smallest of them
stands for the links of that value. This is exact, needs 65 rows per fingerprint however large the
crowd, and no task holds a crowd.

Defined cases: null, empty or blank text has fingerprint zero and is linked like any other; a row
without doc_id takes part and gets the component of its fingerprint, null if no row of that has an
id; repeated rows are each reported; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm.base import table, utf8
from tracewell.llm.graph import components
from tracewell.sources.storage import written

#: Fixed values of the contract: words of a shingle, seed of the hash, most differing bits.
WORDS, SEED, MAX_BITS = 3, 42, 2
BLOCKS = 4
#: Different fingerprints that one pair of blocks may hold to be compared pair by pair.
CROWD = 32


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit k is one if it is one in over half the hashes of the text's word shingles."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(size))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(tokens) - size + 1)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(bits), bitorder="little").view("<i8")[0])


def fingerprinter(words: int, seed: int):
    @arrow_udf("bigint")
    def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array((fingerprint(x.as_py(), words, seed) for x in column), type=pa.int64(), size=len(column))

    return fingerprints


def with_fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", fingerprinter(words, seed)(utf8(F.col("text"))).alias("fp"))


def block_masks() -> list[int]:
    """Masks of the pairs of blocks, as signed 64-bit values."""
    width = 64 // BLOCKS
    blocks = [((1 << width) - 1) << (i * width) for i in range(BLOCKS)]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect every two of the distinct fingerprints ``fp`` at most two bits apart."""
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks()])).alias("pair", "blocks"))
    meeting = keyed.groupBy("pair", "blocks").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    met = written(keyed.join(meeting, ["pair", "blocks"]), "blocks")
    return pair_links(met.where(F.col("crowd") <= CROWD)).unionByName(midpoint_links(met.where(F.col("crowd") > CROWD).select("fp").distinct()))


def pair_links(met: DataFrame) -> DataFrame:
    left, right = met.select("pair", "blocks", F.col("fp").alias("a")), met.select("pair", "blocks", F.col("fp").alias("b"))
    return left.join(right, ["pair", "blocks"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")


def midpoint_links(crowded: DataFrame) -> DataFrame:
    """Every fingerprint and the smallest one within one bit of a common value."""
    flips = [0] + [1 << i for i in range(63)] + [-(1 << 63)]
    values = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("value"))
    smallest = values.groupBy("value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "b")
    return values.join(smallest, "value").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id (smallest id reachable)."""
    hashed = written(with_fingerprints(docs, words, seed), "fingerprints")
    prints = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    groups = components(close_links(prints.select("fp")))
    linked = groups.select(F.col("node").alias("fp"), "root").unionByName(groups.select(F.col("root").alias("fp"), "root").distinct())
    named = written(linked.join(prints, "fp"), "linked")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    moved = named.join(least, "root").select("fp", "least")
    labels = written(prints.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "labels")
    return hashed.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group (doc_id, component_id): the one with the smallest id.

    Of repeated rows with that id one stays; rows without id are kept, as no decision can name them.
    """
    acts = written(groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("doc_id") != F.col("component_id")).alias("goes"), F.count(F.lit(1)).alias("rows")).where("goes OR rows > 1"), "acts")
    once = docs.join(acts.where("NOT goes").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return docs.join(acts.select("doc_id"), "doc_id", "left_anti").unionByName(once).select(*[f"`{c}`" for c in docs.columns])


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates by fingerprint."""
    return one_of_each(docs, near_duplicates(docs.select("doc_id", "text")))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
