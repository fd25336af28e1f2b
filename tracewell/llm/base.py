"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python task works on at a time.
BLOCK_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Lets Python tasks find this package where it is on the executors' disks but not installed."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_column(docs: DataFrame, to: str) -> str:
    """``to``, if no column of ``docs`` has that name in any case; no input column is ever replaced."""
    if to.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the input has a column {to}; name another one for the result")
    return to


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    """UTF-8 bytes, null as empty, so that Python tasks can slice Arrow buffers without decoding."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``BLOCK_BYTES`` of text; one longer text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one byte array, and the offsets of the values in it."""
    values = column.cast(pa.large_binary()) if column.null_count == 0 else pc.fill_null(column, b"").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]
