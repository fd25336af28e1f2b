"""Whitening of embeddings along their leading principal components, by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never built. A pass gives V times a narrow block Q: each task sums
its centred rows times their products with Q, Spark adds the tasks' sums, and a block as narrow as Q comes
back. All eigenvalues lie between 0 and the largest, so a Chebyshev polynomial scaled to [0, b], with b
the least Ritz value of the block, damps everything below b and lifts the wanted end; its three-term recurrence is
one pass a step. After each filter the block is made orthonormal (QR) and rotated to Ritz vectors
(Rayleigh-Ritz). Leading vectors whose residual has reached rounding are locked, and taken out of the
others at every step. The degree is bounded so that the filter never spreads the columns beyond what QR can tell apart.

The iteration ends when the wanted vectors are certified: each residual |V q - e q| is below ``CERTIFIED``
times the largest eigenvalue, and no longer falls. If that takes over ``MOST_PASSES`` passes, the block is doubled, at
last to all dimensions, where one Rayleigh-Ritz step is exact.

Sums are of whole numbers where the result must be exact, and rows are centred before they are multiplied: n x - S is
a whole number, so no digits are lost. Vectors are packed into blocks of rows once, and every pass reads these.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry takes no part, nor does one with an
entry of 2**43 or more in size (no exact whole number); where lengths differ, the most frequent one is kept, the longest
of several; components beyond the rank of the data (eigenvalue under ``RANK`` of the trace) have no rows, so equal
vectors or a single one give none; a deviation beyond 64 bits is null; repeated rows count and are returned each; null
ids are kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.base import table
from tracewell.sources.storage import written

#: Fixed values of the contract: components returned, scale and offset of the whole numbers.
COMPONENTS, SCALE, OFFSET = 8, 1024, 100_000
#: Columns of the block beside the wanted ones, steps of a filter, and how far it may spread the columns.
GUARDS, DEGREE, SPREAD = 24, 12, 1e8
#: Relative residual that certifies, the one that locks, least share of the trace of a component, passes before the block grows.
CERTIFIED, LOCKED, RANK, MOST_PASSES = 1e-11, 1e-15, 1e-12, 240
#: Largest entry, bytes of a packed block, and sums that a long can hold.
LARGEST, BLOCK_BYTES, MOST = 2.0 ** 43, 2 << 20, 2.0 ** 63
SEED = 11


@dataclass
class Packed:
    """Blocks of vectors (ids, data: whole numbers row by row), their number, sums by dimension, and the trace of V."""

    blocks: DataFrame
    n: int
    sums: np.ndarray
    trace: float

    def centred(self, data: bytes) -> np.ndarray:
        return centred(data, self.n, self.sums)


def centred(data: bytes, n: int, sums: np.ndarray) -> np.ndarray:
    return deviations(data, n, sums) / n


def deviations(data: bytes, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S for each row x, as whole numbers."""
    return np.frombuffer(data, "<i8").reshape(-1, len(sums)) * n - sums


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))


def summed(blocks: DataFrame, part: Callable[[bytes], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all blocks of ``part`` (``size`` numbers each): added up per task, then by place in Spark."""
    dtype = np.int64 if kind == "long" else np.float64

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size, dtype), False
        for batch in batches:
            for data in batch.column("data"):
                total += part(data.as_py())
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

    out = np.zeros(size, dtype)
    added = blocks.select("data").mapInArrow(sums, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    for row in added.collect():
        out[row["place"]] = row["value"]
    return out


def packed(vectors: DataFrame, column: str, id_column: str) -> Packed | None:
    """The usable vectors of the most frequent length, packed and written; None where there is none."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return None
    dims, n = most["dims"], most["count"]
    at_once = max(1, BLOCK_BYTES // (8 * dims))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                data = (np.floor(values * SCALE).astype("<i8") + OFFSET).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data], pa.binary())], ["ids", "data"])

    kept = rows.where(F.size("vector") == dims)
    blocks = written(kept.mapInArrow(pack, f"ids array<{dict(rows.dtypes)['id']}>, data binary"), "vector-blocks")
    sums = summed(blocks, lambda data: np.frombuffer(data, "<i8").reshape(-1, dims).sum(axis=0), dims, "long")
    trace = summed(blocks, lambda data: np.array([np.square(centred(data, n, sums)).sum()]), 1, "double")[0] / n
    return Packed(blocks, n, sums, float(trace))


def covariance_times(data: Packed, block: np.ndarray) -> np.ndarray:
    """V times ``block``, in one pass."""
    n, sums = data.n, data.sums

    def part(packed_rows: bytes) -> np.ndarray:
        rows = centred(packed_rows, n, sums)
        return (rows.T @ (rows @ block)).ravel()

    return summed(data.blocks, part, block.size, "double").reshape(block.shape) / n


def chebyshev_filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, first: np.ndarray, above: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """T_degree of V mapped from [0, above] to [-1, 1], applied to ``block``; ``first`` is V times it."""
    half = above / 2
    free = lambda x: x - locked @ (locked.T @ x)
    before, now = block, free(first - half * block) / half
    for _ in range(degree - 1):
        before, now = now, free(2 / half * (times(now) - half * now) - before)
    return now


def degree_for(largest: float, above: float) -> int:
    """As high as ``DEGREE``, but growth beyond ``SPREAD`` at the largest eigenvalue is left to later filters."""
    growth = np.arccosh(max(2 * largest / above - 1, 1 + 1e-12))
    return int(np.clip(np.log(2 * SPREAD) / growth, 1, DEGREE))


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors (columns) of a positive semidefinite matrix given by ``times``."""
    rng, width, passes = np.random.default_rng(SEED), min(dims, wanted + GUARDS), 0
    block = np.linalg.qr(rng.normal(size=(dims, width)))[0]
    best = np.inf
    while True:
        image, passes = times(block), passes + 1
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        scale = max(values[0], np.finfo(float).tiny)
        residuals = np.linalg.norm(image - block * values, axis=0)[:wanted] / scale
        worst = residuals.max()
        if width == dims or worst <= LOCKED or (worst <= CERTIFIED and worst > best / 2) or values[0] <= 0:
            return values[:wanted], block[:, :wanted]
        best = min(best, worst)
        if passes > MOST_PASSES:
            more = min(dims, 2 * width) - width
            block = np.linalg.qr(np.hstack([block, rng.normal(size=(dims, more))]))[0]
            width, passes, best = width + more, 0, np.inf
            continue
        still = int(np.argmax(np.append(residuals > LOCKED, True)))
        above = max(values[-1], scale * 1e-14)
        degree = degree_for(values[still], above)
        moved = chebyshev_filtered(times, block[:, still:], image[:, still:], above, degree, block[:, :still])
        passes += degree - 1
        block = np.linalg.qr(np.hstack([block[:, :still], moved / np.linalg.norm(moved, axis=0)]))[0]


def whitened(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(vectors.select(id_column).dtypes)[id_column]
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    data = packed(vectors, column, id_column)
    if data is None or data.trace <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, dims = data.n, data.sums, len(data.sums)
    values, axes = leading(lambda block: covariance_times(data, block), dims, min(components, dims))
    kept = values > RANK * data.trace
    values, axes = values[kept], axes[:, kept] / np.sqrt(values[kept])
    k, explained = len(values), values / data.trace

    def products(packed_rows: bytes) -> np.ndarray:
        scores = centred(packed_rows, n, sums) @ axes
        return np.append((scores.T @ scores).ravel(), scores.sum(axis=0))

    told = summed(data.blocks, products, k * k + k, "double") / n
    covariance = told[:k * k].reshape(k, k) - np.outer(told[k * k:], told[k * k:])
    error = float(np.abs(covariance - np.eye(k)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed_rows in zip(batch.column("ids"), batch.column("data"), strict=True):
                away = deviations(packed_rows.as_py(), n, sums)
                m, rough = len(away), np.square(away.astype(np.float64)).sum(axis=1)
                exact = pa.array(np.square(away).sum(axis=1), mask=rough >= MOST * (1 - 1e-9))
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), exact.take(pa.array(each)),
                     pa.array((away / n @ axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.blocks.mapInArrow(rows, schema)


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
