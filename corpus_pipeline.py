"""The corpus pipeline: documents in, a mixed training corpus out.

Every stage but the last returns documents with their columns: low quality goes, of near duplicates
one stays, benchmark passages are cut out, secrets are replaced. The last stage returns the documents
that the mix takes, with their size, their source's size and target, and the words taken of each.

Near duplicates are what ``simhash`` links with its own shingle length and bit distance.

Defined cases: null, empty and very long texts pass through every stage whole; an empty table gives no rows, with
the columns of its stage; without labels of both kinds no document is rejected; of repeated rows of one id one stays,
rows without id all stay; equal scores and sizes are settled by id and text hash, so reruns agree; columns
beside those of ``documents`` are kept, and where one has the name of an added column, the added one is called ``mix_``
and its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, mixing, quality, secrets, simhash
from tracewell.llm.base import importable, table
from tracewell.sources.storage import written

#: A trained network and a 64-bit hash that SQL engines lack take part, so no SQL states the result.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return simhash.deduplicated(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicate removal", distinct_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scan", without_secrets),
    ("source mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
