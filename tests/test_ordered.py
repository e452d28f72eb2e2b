"""The distributed scans equal plain windows, whatever the partitioning, and hot keys do not gather in one task."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from featforge.operators.ordered import (OrderedTable, add_row_index, cumulative, diff, longest_repetition,
                                         percentile_rank)


def collect(df, key="id"):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: r[0])


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Small partitions are not merged here, so that every scan crosses partition boundaries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows belong to key 0; every seventh value is null."""
    return spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        ((F.col("id") * 7919) % 4001).alias("t"),
        F.when(F.col("id") % 7 != 0, ((F.col("id") * 31) % 97).cast("double")).alias("v")).cache()


@pytest.mark.parametrize("partitions", [1, 8])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_running_equals_window(spark, skewed, partitions, by):
    got = OrderedTable(skewed.repartition(partitions), ["t"], by).running(
        sums={"s": "v"}, lags={"p": "v"}, row_number="rn").select("id", "s", "p", "rn")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("t")
    want = skewed.select("id", F.sum(F.coalesce("v", F.lit(0.0))).over(w).alias("s"), F.lag("v").over(w).alias("p"),
                         F.row_number().over(w).cast("long").alias("rn"))
    assert collect(got) == collect(want)


def test_hot_key_is_split(skewed):
    sizes = OrderedTable(skewed, ["t"], ["k"]).rows.where("k = 0").groupBy("_part").count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 1200


def test_row_index_is_dense(skewed):
    got = add_row_index(skewed, ["k", "t"], "n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(got) == (1, 4000, 4000)


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None), (4, 40.0)], "id int, v double")
    out = collect(cumulative(df, ["v"], ["id"]).drop("v"))
    assert out == [(1, None, 10.0, 10.0), (2, 10.0, 30.0, 15.0), (3, None, None, None), (4, None, 70.0, pytest.approx(70 / 3))]
    ranked = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, None)], "id int, v int")
    assert collect(percentile_rank(ranked, "v").drop("v")) == [
        (1, pytest.approx(1 / 3)), (2, pytest.approx(5 / 6)), (3, pytest.approx(5 / 6)), (4, None)]


def test_all_null_and_one_row(spark):
    df = spark.createDataFrame([(1, None)], "id int, v double")
    assert collect(diff(df, ["v"], ["id"]).drop("v")) == [(1, None)]
    assert collect(percentile_rank(df, "v").drop("v")) == [(1, None)]


def test_longest_repetition(spark):
    rows = [(1, i, v) for i, v in enumerate(["a", "a", None, "a", "b", "b", "b"])] + [(2, 0, None)]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    assert collect(longest_repetition(df, "k", ["t"], "v")) == [(1, "a"), (2, None)]


def test_longest_repetition_across_partitions(spark, skewed):
    """One key whose single long run spans every partition."""
    df = skewed.select(F.lit(1).alias("k"), "t", F.when(F.col("t") < 100, "x").otherwise("y").alias("v"))
    assert collect(longest_repetition(df, "k", ["t"], "v")) == [(1, "y")]


def test_ranks_of_many_columns_equal_one_by_one(spark):
    rows = [(i, float(i % 5) if i % 7 else None, i % 3, None if i % 2 else -i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b int, c int").repartition(6)
    from featforge.operators import ordered as W
    many = W.percentile_ranks(df, ["a", "b", "c"])
    one = df
    for c in ("a", "b", "c"):
        one = W.percentile_rank(one, c)
    assert many.columns == one.columns
    assert [tuple(r) for r in many.orderBy("id").collect()] == [tuple(r) for r in one.orderBy("id").collect()]
    assert W.percentile_ranks(df, []) is df and W.percentile_ranks(df.limit(0), ["a"]).count() == 0
