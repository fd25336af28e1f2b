"""Text work is dealt to tasks by rows, not by splits: one file of one row group must not be one task."""

from pyspark.sql import functions as F

from tracewell.functions import skew


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def one_group(spark, folder, rows):
    spark.range(rows).coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder)


def test_many_empty_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    one_group(spark, str(tmp_path / "t"), 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() > 8
        dealt = sizes(skew.spread(df))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(dealt) == 5000 and len(dealt) == 50 and max(dealt) <= 200
