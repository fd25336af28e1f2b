"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are whole lower-cased words and the first 4, 5 and 6 characters of longer ones. Of those
seen in the training sample the ``FEATURES`` that tell toxic from other documents best are used, where
their log-likelihood gain reaches ``LEAST_GAIN`` and they are at least ``LEAST_ODDS`` times as frequent in
toxic documents, each as present or not and by its rate. One weight per feature serves all ordered thresholds:
P(grade >= k) = logistic(weights . features - threshold k). The severity is the expected grade, the
sum of these probabilities; a document is called toxic if P(grade >= 1) is one half or more.

The labels say toxic or not. Toxic documents of the sample are graded 1 to ``GRADES`` by equal
shares of their rate of evidence: features at least ``EVIDENCE`` times as frequent in toxic documents.

Training takes a bounded sample: of each label the ``TRAIN_DOCS`` documents with the smallest hash of
their id, equal texts once. Feature counts are made on the executors; the driver gets the chosen features and, per
sampled document, its counts of these.

Defined cases: null and empty texts have no features and get the severity of that; a null label is
not learned from; where one label is missing altogether, severity is 0 and nothing is toxic; repeated
rows are scored each; an empty table gives no rows;
an input column with the name of the added one is refused; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm.base import new_column, table

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
FEATURES, LEAST_DOCS, LEAST_GAIN, TRAIN_DOCS = 500, 5, 12.0, 4000
LEAST_ODDS, GRADES, EVIDENCE = 4.0, 3, 20.0
STEPS, RATE, DECAY = 600, 0.05, 1e-5
REMEMBERED = 1_000_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


@dataclass
class Severity:
    """Feature numbers, weights (presence, then rate) and ordered thresholds."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """How often each feature occurs, and the number of words."""
        words = WORD.findall((text or "").lower())
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.known[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            for i in found:
                counts[i] = counts.get(i, 0) + n
        return counts, len(words)

    def reached(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for each k."""
        counts, words = self.counts(text)
        score = sum(self.weights[0, i] + self.weights[1, i] * rate(n, words) for i, n in counts.items())
        return logistic(score - self.thresholds)


def rate(count, words):
    return np.log1p(100 * count / words)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Design:
    """The sparse feature table: for each entry its row, feature number and rate; grades and weight of each row."""

    row: np.ndarray
    column: np.ndarray
    by_rate: np.ndarray
    grades: np.ndarray
    class_weight: np.ndarray

    @classmethod
    def of(cls, counts: list[dict[int, int]], words: list[int], grades: np.ndarray, class_weight: np.ndarray) -> Design:
        row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        by_rate = rate(np.array([n for c in counts for n in c.values()], dtype=float), np.maximum(np.array(words), 1)[row])
        return cls(row, np.array([i for c in counts for i in c], dtype=np.int64), by_rate, grades, class_weight)


def thresholds(first: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the lowest one and the logarithms of the gaps between them."""
    return np.cumsum(np.append(first[:1], np.exp(first[1:])))


def gradient(design: Design, weights: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted negative log-likelihood of all thresholds together, by the weights and by ``first``."""
    features, rows = weights.shape[1], len(design.grades)
    score = np.bincount(design.row, weights[0, design.column] + weights[1, design.column] * design.by_rate, rows)
    above = design.grades[:, None] >= np.arange(1, GRADES + 1)
    error = (logistic(score[:, None] - thresholds(first)) - above) * design.class_weight[:, None] / rows
    back = error.sum(axis=1)[design.row]
    to_weights = np.stack([np.bincount(design.column, back, features), np.bincount(design.column, back * design.by_rate, features)])
    to_gaps = -np.cumsum(error.sum(axis=0)[::-1])[::-1]
    return to_weights + DECAY * weights, np.append(to_gaps[:1], to_gaps[1:] * np.exp(first[1:]))


def train(design: Design, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam."""
    params = [np.zeros((2, features)), np.array([1.0, *[-1.0] * (GRADES - 1)])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, STEPS + 1):
        for p, g, (m, v) in zip(params, gradient(design, *params), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params[0], thresholds(params[1])


def sampled(docs: DataFrame, labels: DataFrame, train_docs: int) -> tuple[DataFrame, float]:
    """Texts and labels of the bounded sample, and the share of toxic among all labelled rows."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for t in (0, 1)]
    met = docs.select("doc_id", "text").join(chosen[0].unionByName(chosen[1]), "doc_id")
    return met.dropDuplicates(["text", "toxic"]), share


def telling_features(sample: DataFrame) -> list[tuple[str, float]]:
    """The features that tell the labels apart best, and how many times as frequent each is in toxic documents."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for feature in {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}:
                    seen.setdefault(feature, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1)]], ["feature", "n0", "n1"])

    totals = dict(sample.groupBy("toxic").count().collect())
    size0, size1 = totals.get(0, 0) + 1, totals.get(1, 0) + 1
    counted = sample.select("text", "toxic").mapInArrow(distinct, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p0, p1, p = (F.col("n0") + 0.5) / size0, (F.col("n1") + 0.5) / size1, (F.col("n0") + F.col("n1") + 1) / (size0 + size1)
    side = lambda q: q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p))
    gain = size0 * side(p0) + size1 * side(p1)
    best = counted.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).select("feature", (p1 / p0).alias("odds"), gain.alias("gain"))
    return [(r["feature"], r["odds"]) for r in best.where((F.col("gain") >= LEAST_GAIN) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Severity | None:
    sample, share = sampled(docs, labels, train_docs)
    if not 0 < share < 1:
        return None
    found = telling_features(sample)
    index = {f: i for i, (f, _) in enumerate(found)}
    model = Severity(index, np.zeros((2, len(found))), np.zeros(GRADES))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.counts(t) for t in batch.column("text").to_pylist()]
            flat = [[x for pair in sorted(c.items()) for x in pair] for c, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([n for _, n in rows], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "counts"])

    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.select("doc_id", "toxic", "text").mapInArrow(counted, f"doc_id {kind}, toxic int, words long, counts array<long>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["words"], r["counts"]))
    counts = [dict(zip(r["counts"][::2], r["counts"][1::2], strict=True)) for r in rows]
    words, toxic = [r["words"] for r in rows], np.array([r["toxic"] for r in rows])
    if not 0 < toxic.sum() < len(toxic):
        return None
    evidence = {i for i, (_, odds) in enumerate(found) if odds >= EVIDENCE}
    rates = np.array([sum(n for i, n in c.items() if i in evidence) / max(w, 1) for c, w in zip(counts, words, strict=True)])
    cuts = np.quantile(rates[toxic == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, rates, side="left"), 0)
    class_weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    model.weights, model.thresholds = train(Design.of(counts, words, grades, class_weight), len(found))
    return model


def with_severity(docs: DataFrame, model: Severity | None, to: str = "reached") -> DataFrame:
    """``docs`` with P(grade >= k) for k = 1, 2, .. in column ``to``."""
    if model is None:
        return docs.withColumn(new_column(docs, to), F.array(*[F.lit(0.0)] * GRADES))
    model.known = {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("array<double>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array((shared.value.reached(x.as_py()).tolist() for x in column), type=pa.list_(pa.float64()), size=len(column))

    return docs.withColumn(new_column(docs, to), score(F.col("text")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    severity = F.aggregate("reached", F.lit(0.0), lambda s, p: s + p)
    return scored.select(
        "doc_id", severity.alias("severity"), F.round(severity).cast("int").alias("grade"), F.element_at("reached", 1).alias("probability"),
        (F.element_at("reached", 1) >= 0.5).cast("int").alias("toxic"))
