"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards by hash. A shard's tree splits at medians, always along the widest side
of the node's tight bounding box. For a query, the best score that a box can hold is the sum over
its sides of the larger product; nodes are visited best first, and the traversal ends when no open
node can beat the k-th score so far. Among equal scores the smaller id wins, so a node also knows its
smallest id, and a box that only ties is entered only for a smaller one.

The k-th score travels: each block of queries first meets one shard, which gives every query a valid
k-th score, and that score is the starting bound at all shards. Trees are built once, one row per
shard, and meet the queries in blocks: each block goes to each shard. That work is the query set
against all rows; only k rows per query and shard come back.

Defined cases: a vector that is null or holds a null or non-finite component takes no part;
vectors of different length are never compared; a query leaves out one row, itself: repeated rows of
its id are candidates, and each repeated query is answered; with fewer candidates than k all are
returned; an empty table gives no rows; sums that may leave 64 bits are worked out in unbounded whole numbers;
a component that does not fit a long after quantising, and a score among the k best that does not fit one,
are errors; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.base import table
from tracewell.sources.storage import written

#: Fixed values of the contract.
K, QUERY_EVERY, SCALE = 5, 50, 256
#: Vectors of a shard (on average), of a leaf, and queries of a block (at most).
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8192, 64, 1024
#: Products below these are exact in double precision and in 64 bits; rounding of the estimates stays far below the last factor.
EXACT, WHOLE = 2.0 ** 53, 2.0 ** 62
NO_FLOOR = np.iinfo(np.int64).min
#: Scores that do not fit a long stand at these until they are known to be among the best, or not.
LEAST, MOST = int(np.iinfo(np.int64).min) + 1, int(np.iinfo(np.int64).max)


def quantised(vector: Column) -> Column:
    """Components as whole numbers; null where the vector takes no part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    usable = vector.isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(numbers, lambda x: F.when(F.abs(x * SCALE) < 2.0 ** 63, F.floor(x * SCALE).cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("component beyond 64 bits after quantising: "), x.cast("string"))).cast("long"))))


def spaced(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()].reshape(len(column), -1)


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype="<i8").tobytes()


def largest(values: np.ndarray) -> float:
    """The largest absolute value, as a double; that of the least long too."""
    return float(np.abs(values.astype(np.float64)).max()) if values.size else 0.0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exact; sums that do not fit a long are cut at ``LEAST`` and ``MOST``."""
    most = largest(a) * largest(b) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < WHOLE:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


class Tree:
    """A KD-tree in arrays; node i has children 2i+1 and 2i+2, leaves hold rows of ``ids`` and ``vectors``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.nodes: list[tuple[int, int]] = []

    @staticmethod
    def order(ids: np.ndarray, vectors: np.ndarray, depth: int) -> np.ndarray:
        """Rows in leaf order: each level halves every part at the median of its widest side."""
        parts = [np.lexsort((ids,))]
        for _ in range(depth):
            halves = []
            for rows in parts:
                own = vectors[rows]
                side = int(np.argmax(own.max(axis=0).astype(np.float64) - own.min(axis=0))) if own.size else 0
                rows = rows[np.argsort(own[:, side], kind="stable")] if own.size else rows
                halves += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
            parts = halves
        return np.concatenate(parts)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        depth = 0
        while (len(ids) >> (depth + 1)) >= LEAF_ROWS:
            depth += 1
        rows = cls.order(ids, vectors, depth)
        return cls.opened(ids[rows], vectors[rows])

    @classmethod
    def opened(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        """The tree of rows that are in leaf order: halving gives the parts again, the boxes are measured."""
        tree = cls(ids, vectors)
        depth = 0
        while (len(ids) >> (depth + 1)) >= LEAF_ROWS:
            depth += 1
        level = [(0, len(ids))]
        tree.nodes = list(level)
        for _ in range(depth):
            level = [half for a, b in level for half in ((a, a + (b - a) // 2), (a + (b - a) // 2, b))]
            tree.nodes += level
        tree.low = np.array([vectors[a:b].min(axis=0) for a, b in tree.nodes])
        tree.high = np.array([vectors[a:b].max(axis=0) for a, b in tree.nodes])
        tree.least = [int(ids[a:b].min()) for a, b in tree.nodes]
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Best score that each node's box can hold, for each query."""
        both = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        return products(both, np.concatenate([self.high, self.low], axis=1))

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) of the shard that reach ``floor``, best first."""
        best: list[tuple[int, int]] = []
        open_nodes = [(-int(bounds[0]), self.least[0], 0)]
        while open_nodes:
            negative, least, node = heapq.heappop(open_nodes)
            if (floor is not None and -negative < floor) or (len(best) == k and -negative < best[0][0]):
                break
            if len(best) == k and (-negative, -least) <= best[0]:
                continue
            child = 2 * node + 1
            if child < len(self.nodes):
                for c in (child, child + 1):
                    heapq.heappush(open_nodes, (-int(bounds[c]), self.least[c], c))
                continue
            a, b = self.nodes[node]
            scores = products(query[None, :], self.vectors[a:b])[0]
            entry = max(floor if floor is not None else scores.min(), best[0][0] if len(best) == k else scores.min())
            for i in np.flatnonzero(scores >= entry).tolist():
                pair = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)
        return sorted(best, reverse=True)


def pack(kind: str):
    """Rows of a group (shard or query block) as one row of packed numbers."""

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, vectors = group["vec_id"].to_numpy(), matrix(group["vector"].combine_chunks())
        if kind == "shard":
            tree = Tree.build(ids, vectors)
            ids, vectors = tree.ids, tree.vectors
        return pa.table({"part": group["part"][:1], "dims": group["dims"][:1], "ids": pa.array([blob(ids)], pa.binary()), "vectors": pa.array([blob(vectors)], pa.binary())})

    return packed


def packed_parts(rows: DataFrame, per_part: int, kind: str) -> DataFrame:
    """``rows`` dealt by hash to parts of about ``per_part`` rows, one row per part."""
    parts = spaced(rows.count(), per_part)
    dealt = rows.withColumn("dims", F.size("vector")).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)))
    return written(dealt.groupBy("part", "dims").applyInArrow(pack(kind), "part long, dims int, ids binary, vectors binary"), kind)


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    read = np.frombuffer(ids, dtype="<i8")
    return read, np.frombuffer(vectors, dtype="<i8").reshape(len(read), -1)


def searcher(k: int):
    """Searches each shard for each query of the block beside it; one more than k, as the query's own row may be among them."""
    schema = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("row", pa.int32()), ("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for pair in batch.to_pylist():
                if held != (pair["shard"], pair["dims"]):
                    held, tree = (pair["shard"], pair["dims"]), Tree.opened(*unpack(pair["ids"], pair["vectors"]))
                query_ids, queries = unpack(pair["query_ids"], pair["queries"])
                floors = np.frombuffer(pair["floors"], dtype="<i8") if pair["floors"] else None
                bounds, found = tree.bounds(queries), []
                for row in range(len(query_ids)):
                    own = int(products(queries[row:row + 1], queries[row:row + 1])[0, 0])
                    floor = None if floors is None or row >= len(floors) or floors[row] == NO_FLOOR else int(floors[row])
                    found += [(pair["block"], pair["dims"], row, int(query_ids[row]), own, -i, s) for s, i in tree.search(queries[row], bounds[row], k + 1, floor)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema, strict=True)], schema=schema)

    return search


FOUND = "block long, dims int, row int, query_id long, own long, vec_id long, score long"


def best(found: DataFrame, k: int) -> DataFrame:
    """Rank of each found row among those of its query; the query's own row, one of its id and own score, has none."""
    query = Window.partitionBy("block", "dims", "row")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    copies = F.row_number().over(Window.partitionBy("block", "dims", "row", own).orderBy("vec_id"))
    others = found.withColumn("is_own", own & (copies == 1)).where("NOT is_own")
    return others.withColumn("rank", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def floors(found: DataFrame, k: int) -> DataFrame:
    """The k-th score of each query so far, packed in row order per block; ``NO_FLOOR`` where there are fewer."""
    kth = best(found, k).where(F.col("rank") == k).select("block", "dims", "row", "score")

    def packed(group: pa.Table) -> pa.Table:
        rows, scores = group["row"].to_numpy(), group["score"].to_numpy()
        out = np.full(int(rows.max()) + 1, NO_FLOOR)
        out[rows] = scores
        return pa.table({"block": group["block"][:1], "dims": group["dims"][:1], "floors": pa.array([blob(out)], pa.binary())})

    return kth.groupBy("block", "dims").applyInArrow(packed, "block long, dims int, floors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For every row of ``queries`` the k best rows of ``vectors``, both (vec_id, vector of long):
    query_id, rank, vec_id, score."""
    shards = packed_parts(vectors, SHARD_ROWS, "shard").withColumnRenamed("part", "shard")
    blocks = packed_parts(queries, BLOCK_QUERIES, "queries").select(
        F.col("part").alias("block"), "dims", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    names = shards.select("shard", "dims")
    # In order: the list is worked out more than once, and a block must have the same first shard each time.
    home = blocks.join(names.groupBy("dims").agg(F.array_sort(F.collect_list("shard")).alias("all")), "dims")
    home = home.withColumn("shard", F.element_at("all", (F.pmod("block", F.size("all")) + 1).cast("int"))).drop("all").withColumn("floors", F.lit(None).cast("binary"))
    first = written(home.join(shards, ["shard", "dims"]).mapInArrow(searcher(k), FOUND), "first")
    bounded = blocks.join(floors(first, k), ["block", "dims"], "left")
    rest = bounded.join(names, "dims").join(home.select("block", "dims", "shard"), ["block", "dims", "shard"], "left_anti")
    found = rest.repartition("shard", "block").join(shards, ["shard", "dims"]).mapInArrow(searcher(k), FOUND)
    fits = F.when(F.col("score").between(LEAST + 1, MOST - 1), F.col("score")).otherwise(
        F.raise_error(F.concat(F.lit("score beyond 64 bits of query "), F.col("query_id").cast("string"))).cast("long"))
    return best(first.unionByName(found), k).select("query_id", "rank", "vec_id", fits.alias("score"))


def op10_exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


OP10_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
