"""Benchmark decontamination with a broadcast hash set of the test set's word windows.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. A window
is ten consecutive words of an item; a shorter item is one window. The windows go to every task as
a hash set. A task numbers the words of its texts by the test set's vocabulary, hashes every window
whose words are all known, looks the hashes up and verifies each find word by word.

The broadcast is bounded: the windows are dealt in blocks of at most ``MAX_WINDOWS``. A larger
test set takes several blocks, through which the documents stream one after the other within
the same tasks, without a shuffle.

Defined cases: null text has no words and no hits; a null item text has no windows; windows of an
item without id count as hits but list no item; repeated items are listed once, repeated documents
are scanned each; with an empty test set nothing is hit;
an input column with the name of the added one is refused; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm.base import new_column, table, text_blocks, utf8

WINDOW = 10
#: Windows in one broadcast, and words of one item that reach the driver at a time.
MAX_WINDOWS = 500_000
#: Share of hit words from which the pipeline drops a document instead of cutting the hits out.
DROP_SHARE = 0.2
#: Word characters by byte, A-Z to a-z, all else a blank.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FOUND = "struct<n_words: bigint, hits: array<int>, items: array<string>>"


class WindowSet:
    """Hashes of windows by length, with the items of each window for verification."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], set[str]]] = {}
        self.hashes: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, item_id: str | None, text: str | None) -> None:
        words = (text or "").encode().translate(WORD_BYTES).split()
        ids = [self.words.setdefault(w, len(self.words)) for w in words]
        length = min(WINDOW, len(ids))
        for i in range(len(ids) - length + 1 if ids else 0):
            known = self.items.setdefault(length, {})
            self.size += tuple(ids[i:i + length]) not in known
            known.setdefault(tuple(ids[i:i + length]), set()).update([] if item_id is None else [item_id])

    def close(self) -> WindowSet:
        for length, windows in self.items.items():
            ids = np.array(list(windows), dtype=np.int64).reshape(-1, length)
            self.hashes[length] = np.unique(window_hash(ids.T))
        return self

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """Position, length and items of every window in ``ids``, where -1 is an unknown word."""
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for length, hashes in self.hashes.items():
            starts = np.flatnonzero(unknown[length:] == unknown[:-length]) if len(ids) >= length else np.zeros(0, np.int64)
            if not len(starts):
                continue
            hashed = window_hash(ids[starts + j] for j in range(length))
            at = np.searchsorted(hashes, hashed)
            for i in starts[hashes[np.minimum(at, len(hashes) - 1)] == hashed].tolist():
                items = self.items[length].get(tuple(ids[i:i + length].tolist()))
                if items is not None:
                    yield i, length, items


def window_hash(columns) -> np.ndarray:
    hashed = np.uint64(0)
    for column in columns:
        hashed = (hashed + column.astype(np.uint64) + np.uint64(1)) * FACTOR
        hashed = hashed ^ (hashed >> np.uint64(29))
    return hashed


def window_sets(benchmark: DataFrame) -> Iterator[WindowSet]:
    """The windows of ``benchmark`` in blocks; the driver holds one block at a time."""
    block = WindowSet()
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        block.add(row[0], row[1])
        if block.size >= MAX_WINDOWS:
            yield block.close()
            block = WindowSet()
    yield block.close()


def runs(mask: np.ndarray) -> list[int]:
    """Start and end of each run of true values, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()


def scan_texts(windows: WindowSet, texts: list[bytes]) -> list[dict]:
    """Word count, runs of hit words and items for each text."""
    known, unknown, parts, counts = windows.words.get, repeat(-1), [], []
    for text in texts:
        words = text.translate(WORD_BYTES).split()
        counts.append(len(words))
        parts += [np.fromiter(map(known, words, unknown), dtype=np.int64, count=len(words)), np.array([-1])]
    found = [{"n_words": n, "hits": [], "items": set()} for n in counts]
    if not texts:
        return found
    ids = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    masks: dict[int, np.ndarray] = {}
    for i, length, items in windows.find(ids):
        k = int(np.searchsorted(starts, i, side="right")) - 1
        mask = masks.setdefault(k, np.zeros(counts[k], dtype=bool))
        mask[i - starts[k]:i - starts[k] + length] = True
        found[k]["items"] |= items
    for k, mask in masks.items():
        found[k]["hits"] = runs(mask)
    return found


def scanner(shared):
    """Scan with a broadcast window set; ``before`` holds what earlier blocks have found."""

    @arrow_udf(FOUND)
    def scan(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = shared.value
        for texts, before in columns:
            found = []
            for block in text_blocks([pa.RecordBatch.from_arrays([texts], ["text"])]):
                found += scan_texts(windows, block.column(0).to_pylist())
            for new, old in zip(found, before.to_pylist(), strict=True):
                if old is not None:
                    merge(new, old)
                new["items"] = sorted(new["items"])
            yield pa.array(found, type=pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return scan


def merge(new: dict, old: dict) -> None:
    mask = np.zeros(new["n_words"], dtype=bool)
    for ends in (new["hits"], old["hits"]):
        for a, b in zip(ends[::2], ends[1::2], strict=True):
            mask[a:b] = True
    new["hits"] = runs(mask)
    new["items"] |= set(old["items"])


def with_hits(docs: DataFrame, benchmark: DataFrame, to: str = "found") -> DataFrame:
    """``docs`` with column ``to``: word count, runs of hit words (start, end, start, ..), item ids."""
    out = docs.withColumn(new_column(docs, to), F.lit(None).cast(FOUND))
    for windows in window_sets(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        out = out.withColumn(to, scanner(shared)(utf8(F.col("text")), F.col(to)))
    return out


def without(text: bytes, ends: list[int]) -> str:
    """``text`` without the bytes from the first to the last word of each run; a line break stays in place."""
    words = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        kept.append(text[at:words[a][0]])
        at = words[b - 1][1]
    return b"\n".join([*kept, text[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, drop_share: float = DROP_SHARE) -> DataFrame:
    """``docs`` without the benchmark's passages: hit spans are cut out, and a document of which
    ``drop_share`` of the words or more are hit goes. Untouched texts stay byte for byte."""
    names, before = docs.columns, "_" * max(map(len, docs.columns)) + "found"
    *earlier, last = [docs.sparkSession.sparkContext.broadcast(w) for w in window_sets(benchmark)]
    scanned = docs.withColumn(before, F.lit(None).cast(FOUND))
    for shared in earlier:
        scanned = scanned.withColumn(before, scanner(shared)(utf8(F.col("text")), F.col(before)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = scan_texts(last.value, [t or b"" for t in texts])
            for new, old in zip(found, batch.column(before).to_pylist(), strict=True):
                if old is not None:
                    merge(new, old)
            hit = [sum(f["hits"][1::2]) - sum(f["hits"][::2]) for f in found]
            kept = pa.array([n == 0 or n < drop_share * f["n_words"] for n, f in zip(hit, found, strict=True)], pa.bool_())
            clean = [without(t, f["hits"]) if f["hits"] else None for t, f in zip(texts, found, strict=True)]
            changed = {"text": pa.array(clean, batch.column("text").type), "n_chars": pa.array([None if t is None else len(t) for t in clean], pa.int64())}
            columns = []
            for name in names:
                own = batch.column(name)
                if name in changed and any(hit):
                    own = pc.if_else(pa.array([n > 0 for n in hit]), changed[name].cast(own.type), own)
                columns.append(own)
            yield pa.RecordBatch.from_arrays(columns, names).filter(kept)

    return scanned.mapInArrow(cut, docs.schema)


def op9_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    ends = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return found.select(
        "doc_id", "n_words", F.aggregate(ends, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (
    SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, gram)
), hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
