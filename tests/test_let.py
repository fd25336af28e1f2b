"""A bound value is worked out once, may be null, and is not copied by a transform of one element."""

from pyspark.sql import functions as F

from tracewell.functions.text import let


def test_let(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string").select(
        "k", let(F.concat("t", F.lit("!")), lambda x: F.struct(x.alias("x"), F.coalesce(x, F.lit("none")).alias("y"), let(F.length(x), lambda n: n + F.col("k")).alias("n"))).alias("s"))
    assert [(r.s.x, r.s.y, r.s.n) for r in df.orderBy("k").collect()] == [("a!", "a!", 3), (None, "none", None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("!)") == 1
