"""Toxic documents are found in every language, held out from training."""

from pyspark.sql import functions as F

from tracewell.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_toxicity_held_out_by_language(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = toxicity.with_severity(docs, toxicity.fit(docs, labels.where(~own))).join(labels.where(own), "doc_id").select("toxic", "reached", "lang").collect()
    found = {}
    for r in rows:
        if r.toxic == 1:
            found.setdefault(r.lang, []).append(r.reached[0] >= 0.5)
    print({k: (sum(v), len(v)) for k, v in found.items()}, sum(r.reached[0] >= 0.5 for r in rows if r.toxic == 0), sum(r.toxic == 0 for r in rows))
    assert len(found) == 4 and all(sum(v) / len(v) > 0.8 for v in found.values())
    assert sum(r.reached[0] >= 0.5 for r in rows if r.toxic == 0) <= 0.01 * len(rows)
