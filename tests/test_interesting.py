import pytest
from pyspark.sql import functions as F

from featforge.operators import synthesis as D


def test_values_found_are_the_most_common(spark):
    n = 20_000
    value = F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 10 == 1, "warm").when(F.col("id") % 100 == 3, "it's").when(
        F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("rare"), F.col("id")))
    df = spark.range(n).select("id", value.alias("v"), F.lit(None).cast("string").alias("none"), F.col("id").cast("string").alias("own")).repartition(9)
    got = [tuple(r) for r in D.interesting_values(df, k=3, min_share=0.005).orderBy("rank").collect()]
    counts = {r.v: r["count"] for r in df.groupBy("v").count().collect()}
    assert got == [("v", v, counts[v], i + 1) for i, v in enumerate(["hot", "warm", "it's"])]
    assert [r.value for r in D.interesting_values(df, ["v"], k=2, min_share=0.05).orderBy("rank").collect()] == ["hot", "warm"]
    assert D.interesting_values(df.limit(0)).count() == D.interesting_values(df.select("id")).count() == 0
    with pytest.raises(ValueError, match="tracked"):
        D.interesting_values(df, min_share=0.0001)


def test_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"], "v string").repartition(3)
    assert [tuple(r)[1:] for r in D.interesting_values(df, k=2).orderBy("rank").collect()] == [("a", 2, 1), ("b", 2, 2)]
