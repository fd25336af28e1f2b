"""Helpers that keep work spread out when one key, file or object is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 4096


#: Rows of one task of text work, at most about.
TASK_ROWS = 16384


def text_tasks(df: DataFrame) -> int:
    """Tasks for text work over ``df``: one per core at least, and no task of more than about ``TASK_ROWS`` rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out round-robin, so that a task of text work has a bounded number of them.

    Text work is CPU-bound. The number of splits says little about how evenly rows lie in them: a split of a parquet
    file without the middle of a row group is empty, and one large row group is one task. Rows are counted, from
    the footers of the files, and dealt before any text is made of them.
    """
    return df.repartition(text_tasks(df))


def spread_few(df: DataFrame) -> DataFrame:
    """Rows that are costly to count or to move: dealt out only when they have fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def large(df: DataFrame) -> DataFrame:
    """One side of a join that is sorted and merged on both sides, and so never collected by the driver.

    Size estimates follow the files and row widths of a plan, not the text made in it, and so take rows that grow with the
    input for less than the broadcast limit.
    """
    return df.hint("merge")


def first_per_key(df: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """The row with the smallest ``order`` for each key.

    An aggregate, not a window: partial results are combined before the shuffle, so a
    hot key sends one row per task instead of its whole group.
    """
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("picked"))
    return picked.select(*keys, *[F.col("picked")[f].alias(f) for f in fields])


def running(df: DataFrame, keys: list[str], order: str, fills: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Running last non-null values and running sums per key, for groups of any size.

    ``fills`` name -> value whose last non-null up to the row is wanted; ``sums`` name ->
    value to add up to and including the row. Every group is cut into blocks of
    ``BLOCK_ROWS`` consecutive order values. Block totals, one row per block, are carried
    forward first, then each block is finished on its own, so no task ever sorts a whole group.
    """
    block = F.floor(F.col(order) / BLOCK_ROWS).alias("_block")
    base = df.select("*", block, *[v.alias(f"_f_{n}") for n, v in fills.items()], *[v.alias(f"_s_{n}") for n, v in sums.items()])
    totals = base.groupBy(*keys, "_block").agg(
        *[F.max_by(F.col(f"_f_{n}"), F.when(F.col(f"_f_{n}").isNotNull(), F.col(order))).alias(f"_bf_{n}") for n in fills],
        *[F.sum(f"_s_{n}").alias(f"_bs_{n}") for n in sums],
        F.count(F.lit(1)).alias("_rows"),
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block",
        *[F.last(f"_bf_{n}", ignorenulls=True).over(before).alias(f"_cf_{n}") for n in fills],
        *[F.coalesce(F.sum(f"_bs_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(large(carried), [*keys, "_block"])
    return joined.select(
        *df.columns,
        *[F.coalesce(F.last(f"_f_{n}", ignorenulls=True).over(inside), F.col(f"_cf_{n}")).alias(n) for n in fills],
        *[(F.sum(f"_s_{n}").over(inside) + F.col(f"_cs_{n}")).alias(n) for n in sums],
    )
