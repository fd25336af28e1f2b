"""Document quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole. Learned filters run over
each chunk at every byte; the strongest response of each filter is kept per chunk. Over a document's
chunks the maximum and the mean of these responses go through one logistic unit, which gives the
probability of label 1.

Training takes a bounded sample of whole documents: of each label, in the order of the hash of their id, up to
``TRAIN_DOCS`` documents of up to ``TRAIN_CHUNKS`` chunks together; of several texts with one id it takes the
one with the smallest hash. It runs on the driver, with a fixed seed over rows in id order, so the same tables
give the same network. Scoring runs on the executors over every chunk of every text, a few chunks at a time; of a
document only the maximum and sum so far are kept.

Defined cases: null and empty texts are one chunk of padding and get its score; a null or other label
than 0 and 1 is not learned from; where one label is missing altogether, every score is 0.5;
repeated rows are scored each; an empty table gives no rows; an input column with the name of the added one is
refused; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from tracewell.llm.base import new_column, table, text_blocks, utf8

#: Bytes of a chunk, bytes that neighbours share, bytes a filter sees, filters, numbers per byte.
CHUNK, OVERLAP, WIDTH, FILTERS, DEPTH = 512, 32, 12, 48, 8
TRAIN_DOCS, TRAIN_CHUNKS = 2000, 16_000
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 32, 0.004, 1e-4, 7
#: Fixed values of the contract: rows of one fold in five are held out; scores from 0.3 are predicted 1.
FOLDS, KEEP_FROM = 5, 0.3
#: Chunks whose windows are in memory at a time.
AT_ONCE = 32


@dataclass
class Network:
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(normal(257, DEPTH, scale=0.5), normal(WIDTH * DEPTH, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32),
                   normal(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.bias, self.weights, self.offset]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Every window of every chunk (chunk, place, WIDTH * DEPTH), as a view."""
        seen = np.ascontiguousarray(self.bytes_[chunks])
        a, b, _ = seen.strides
        return np.lib.stride_tricks.as_strided(seen, (len(chunks), chunks.shape[1] - WIDTH + 1, WIDTH * DEPTH), (a, b, seen.itemsize))

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        return (self.windows(chunks).reshape(-1, WIDTH * DEPTH) @ self.filters).reshape(len(chunks), -1, FILTERS)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest response of each filter in each chunk, and its place."""
        tops, places = [], []
        for at in range(0, len(chunks), AT_ONCE):
            responses = self.responses(chunks[at:at + AT_ONCE])
            places.append(responses.argmax(axis=1))
            tops.append(np.take_along_axis(responses, places[-1][:, None, :], axis=1)[:, 0])
        return np.concatenate(tops) + self.bias, np.concatenate(places)

    def strongest(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(chunks).max(axis=1) + self.bias, 0)

    def probability(self, peak: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Per document, from the maximum and the mean of its chunks' responses."""
        return logistic(np.concatenate([peak, mean], axis=1) @ self.weights + self.offset)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def n_chunks(size: int) -> int:
    return max(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))


def chunks_of(text: bytes) -> Iterator[np.ndarray]:
    """Overlapping chunks as rows of byte numbers, 256 for padding, up to ``AT_ONCE`` rows at a time."""
    step, n, data = CHUNK - OVERLAP, n_chunks(len(text)), np.frombuffer(text, dtype=np.uint8)
    for first in range(0, n, AT_ONCE):
        out = np.full((min(AT_ONCE, n - first), CHUNK), 256, dtype=np.int16)
        for row in range(len(out)):
            piece = data[(first + row) * step:(first + row) * step + CHUNK]
            out[row, :len(piece)] = piece
        yield out


def train(examples: list[tuple[np.ndarray, int]], share_of_one: float) -> Network | None:
    """A network fitted to (chunks, label); classes weigh as ``share_of_one`` says."""
    labels = np.array([y for _, y in examples], dtype=np.float32)
    if not 0 < labels.sum() < len(labels):
        return None
    class_weight = np.where(labels == 1, share_of_one / labels.mean(), (1 - share_of_one) / (1 - labels.mean())).astype(np.float32)
    rng = np.random.default_rng(SEED)
    net = Network.fresh(rng)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, EPOCHS * -(-len(examples) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            grads = gradients(net, [examples[i][0] for i in rows], labels[rows], class_weight[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) + DECAY * p)
            net.bytes_[256] = 0
    return net


def gradients(net: Network, documents: list[np.ndarray], labels: np.ndarray, class_weight: np.ndarray) -> list[np.ndarray]:
    starts = np.cumsum([0, *map(len, documents)])[:-1]
    chunks = np.concatenate(documents)
    raw, places = net.pooled(chunks)
    held = np.maximum(raw, 0)
    counts = np.diff(np.append(starts, len(held)))
    owner = np.repeat(np.arange(len(documents)), counts)
    peak = np.maximum.reduceat(held, starts)
    summed = np.concatenate([peak, np.add.reduceat(held, starts) / counts[:, None]], axis=1)
    error = (logistic(summed @ net.weights + net.offset) - labels) * class_weight / len(labels)
    back = error[:, None] * net.weights
    is_peak = held == peak[owner]
    to_held = back[owner, FILTERS:] / counts[owner, None] + np.where(is_peak, back[owner, :FILTERS], 0)
    to_raw = (to_held * (raw > 0)).astype(np.float32)
    to_filters, to_bytes = np.zeros_like(net.filters), np.zeros((257, DEPTH))
    for at in range(0, len(chunks), AT_ONCE):
        part, own = slice(at, at + AT_ONCE), chunks[at:at + AT_ONCE]
        seen = own[np.arange(len(own))[:, None, None], places[part, :, None] + np.arange(WIDTH)]
        to_filters += np.einsum("cf,cfk->kf", to_raw[part], net.bytes_[seen].reshape(len(own), FILTERS, WIDTH * DEPTH))
        to_inputs = (to_raw[part, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
        to_bytes += np.stack([np.bincount(seen.reshape(-1), to_inputs[:, d], 257) for d in range(DEPTH)], axis=1)
    return [to_bytes.astype(np.float32), to_filters, to_raw.sum(axis=0), (summed * error[:, None]).sum(axis=0).astype(np.float32), error.sum(keepdims=True).astype(np.float32)]


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability for each text, over all its chunks; ``AT_ONCE`` chunks of one or several texts are scored together."""
    peak, total = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS))
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        held = net.strongest(np.concatenate(waiting))
        starts = np.cumsum([0, *map(len, waiting)])[:-1]
        np.maximum.at(peak, owners, np.maximum.reduceat(held, starts))
        np.add.at(total, owners, np.add.reduceat(held.astype(np.float64), starts))
        waiting.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for block in chunks_of(text):
            if waiting and sum(map(len, waiting)) + len(block) > AT_ONCE:
                flush()
            waiting.append(block)
            owners.append(i)
    if waiting:
        flush()
    counts = np.array([n_chunks(len(t)) for t in texts])[:, None]
    return net.probability(peak, (total / counts).astype(np.float32)).astype(np.float64) if texts else np.zeros(0)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chunks: int = TRAIN_CHUNKS) -> tuple[list[tuple[np.ndarray, int]], float]:
    """The bounded sample, and the share of label 1 among all labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0] or 0.0
    sampled = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for q in (0, 1)]
    texts = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    met = texts.join(sampled[0].unionByName(sampled[1]), "doc_id").withColumn("digest", F.xxhash64("text"))
    # One row per id and label from here on, so the running sum is over at most ``train_docs`` rows of each label.
    sizes = met.groupBy("doc_id", "quality").agg(F.min(F.struct("digest", F.octet_length("text").alias("size"))).alias("own"))
    chunks = F.greatest(F.lit(1), F.ceil((F.col("own.size") - OVERLAP) / (CHUNK - OVERLAP)))
    so_far = F.sum(chunks).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = sizes.select("doc_id", "quality", F.col("own.digest").alias("digest"), so_far.alias("so_far")).where(F.col("so_far") <= train_chunks).drop("so_far")
    chosen = met.join(fits, ["doc_id", "quality", "digest"]).dropDuplicates(["doc_id", "quality"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.concatenate(list(chunks_of(t))).astype("<i2").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "chunks"])

    kind = dict(chosen.dtypes)["doc_id"]
    rows = chosen.select("doc_id", "quality", "text").mapInArrow(cut, f"doc_id {kind}, quality int, chunks binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["chunks"])))
    return [(np.frombuffer(r["chunks"], "<i2").reshape(-1, CHUNK), r["quality"]) for r in rows], share


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    return train(*training_rows(docs, labels))


def with_quality(docs: DataFrame, net: Network | None, to: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``to``."""
    if net is None:
        return docs.withColumn(new_column(docs, to), F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            blocks = text_blocks([pa.RecordBatch.from_arrays([column], ["text"])])
            yield pa.array(np.concatenate([np.zeros(0), *[scores(shared.value, b.column(0).to_pylist()) for b in blocks]]), type=pa.float64())

    return docs.withColumn(new_column(docs, to), score(utf8(F.col("text"))))


def kept_documents(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that score ``keep_from`` or more, with their columns."""
    net = fit(docs, labels)
    if net is None:
        return docs if keep_from <= 0.5 else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(scores(shared.value, texts) >= keep_from))

    return docs.mapInArrow(keep, docs.schema)


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
