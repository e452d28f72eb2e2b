import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.operators import oversample as O
from featforge.operators.oversample import nearest_neighbours, smote


def brute(points, k):
    out = {}
    for i, (a, x) in enumerate(points):
        d = sorted((float(np.sqrt(sum((u - v) ** 2 for u, v in zip(x, y)))), b) for j, (b, y) in enumerate(points) if j != i)
        out[a] = [round(v, 9) for v, _ in d[:k]]
    return out


@pytest.mark.parametrize("block", [16, 1000])
def test_neighbours_are_exact(spark, block):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 2)) * [3, 1], 3)
    x[:100] = [0.5, 0.25]  # a third of the rows are the same point
    points = [(i, [float(u), float(v)]) for i, (u, v) in enumerate(x)]
    df = spark.createDataFrame([(i, *v) for i, v in points], "id long, a double, b double")
    got = {}
    for r in nearest_neighbours(df, "id", ["a", "b"], 4, block).orderBy("id", "rank").collect():
        assert r["neighbour"] != r["id"]
        got.setdefault(r["id"], []).append(round(r["distance"], 9))
    assert got == brute(points, 4)


def test_small_class(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id long, a double")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in nearest_neighbours(df, "id", ["a"], 5, 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}


def test_classes_become_equal(spark):
    df = spark.range(500).select("id", (F.col("id") % 13).cast("double").alias("a"), (F.col("id") * 7 % 29).cast("double").alias("b"),
                                 (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = smote(df, ["a", "b"], "y", "id").cache()
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 450, 1: 450}
    made = out.where("id is null")
    bounds = df.where("y = 1").agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    inside = made.where(F.col("a").between(bounds[0], bounds[1]) & F.col("b").between(bounds[2], bounds[3])).count()
    assert made.count() == inside == 400
    again = smote(df.repartition(7), ["a", "b"], "y", "id")
    rows = lambda d: sorted((round(r["a"], 9), round(r["b"], 9)) for r in d.where("id is null").collect())
    assert rows(again) == rows(out)


def test_rows_without_neighbours_raise(spark):
    import pytest

    from featforge.operators.oversample import smote
    rows = [(i, float(i), int(i < 3)) for i in range(30)]
    for bad in (None, float("nan"), float("inf")):
        df = spark.createDataFrame([(0, bad, 1), *rows[1:]], "id long, x double, y int")
        with pytest.raises(ValueError, match="impute"):
            smote(df, ["x"], "y", "id")
    with pytest.raises(ValueError, match="single row"):
        smote(spark.createDataFrame(rows[2:], "id long, x double, y int"), ["x"], "y", "id")


def test_hashed_neighbours_of_one_bucket_are_exact(spark):
    rng = np.random.default_rng(2)
    points = [(i, [float(u), float(v)]) for i, (u, v) in enumerate(np.round(rng.normal(size=(200, 2)), 3))]
    df = spark.createDataFrame([(i, *v) for i, v in points], "id long, a double, b double").repartition(5)
    exact = nearest_neighbours(df, "id", ["a", "b"], 4).select("id", "rank", "neighbour").collect()
    got = O.hashed_neighbours(df, "id", ["a", "b"], 4, tables=1, leaf=512)
    assert sorted(got.select("id", "rank", "neighbour").collect()) == sorted(exact)
    assert O.hashed_neighbours(df.limit(0), "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("width", [3, 10])
def test_recall_of_hashed_neighbours(spark, width):
    names = [f"f{i}" for i in range(width)]
    df = spark.range(12_000).select("id", *[F.rand(i + 1).alias(n) for i, n in enumerate(names)]).repartition(8).cache()
    found = O.hashed_neighbours(df, "id", names, 5, leaf=256).cache()
    assert O.measured_recall(df, "id", names, found) >= 0.9
    # Every row has its k neighbours, none is the row itself, and the ranks are gapless.
    rows = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.count_if(F.col("id") == F.col("neighbour")).alias("own"))
    assert [tuple(r) for r in rows.select("n", "last", "own").distinct().collect()] == [(5, 5, 0)] and rows.count() == 12_000


def test_work_of_hashed_neighbours_is_linear(spark):
    """Rows of a bucket stay near its size, at twice and four times the rows, also where a third of them are one point."""
    names, leaf = [f"f{i}" for i in range(10)], 128
    for n in (4_000, 16_000):
        cells = [F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(i + 1)) for i in range(10)]
        points = spark.range(n).select("id", F.array(*cells).alias("x")).repartition(8)
        met = O._buckets(points, 10, 2, leaf, 1).groupBy("t", "node", "part").count().agg(F.max("count"), F.sum("count")).first()
        assert met[0] <= 6 * leaf and met[1] == 2 * n
    df = spark.range(3_000).select("id", *[F.lit(1.0).alias(n) for n in names])
    found = O.hashed_neighbours(df, "id", names, 3, tables=2, leaf=128)
    assert found.groupBy("id").count().filter("count = 3").count() == 3_000


def test_both_methods_make_equal_classes(spark):
    df = spark.range(300).select("id", (F.col("id") * 7 % 29).cast("double").alias("a"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    made = [sorted(tuple(r) for r in smote(df, ["a"], "y", "id", method=m).filter("id is null").collect()) for m in ("hashed", "exact")]
    assert made[0] == made[1] and len(made[0]) == 240
    with pytest.raises(ValueError, match="neither"):
        smote(df, ["a"], "y", "id", method="other")


def pairs(rows, k):
    """What SQL gives: each pair of rows with different keys, by distance and the other key."""
    out = {}
    for a, *x in rows:
        if a is not None and None not in x and np.isfinite(x).all():
            out.setdefault(a, []).extend((float(np.sqrt(sum((u - v) ** 2 for u, v in zip(x, y)))), b) for b, *y in rows
                                         if b is not None and b != a and None not in y and np.isfinite(y).all())
    return {(a, rank): b for a, found in out.items() for rank, (_, b) in enumerate(sorted(found)[:k], 1)}


@pytest.mark.parametrize("block", [8, 40])
def test_exact_neighbours_in_many_cells(spark, monkeypatch, block):
    """A widest feature of few values, ties, repeated keys and rows, rows without key or with features that aren't finite."""
    monkeypatch.setattr(O, "BLOCKS", 1)
    rng = np.random.default_rng(3)
    rows = [(i, float(u), float(v)) for i, (u, v) in enumerate(zip(rng.integers(0, 6, 500) * 10, np.round(rng.random(500) * 3, 1)))]
    rows += [*rows[:40], *[(i, 3.0, 1.0) for i in range(10)], (None, 1.0, 1.0), (900, None, 1.0), (901, 1.0, float("nan")), (902, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(7)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in nearest_neighbours(df, "id", ["a", "b"], 4, block).collect()}
    assert got == pairs(rows, 4)


@pytest.mark.parametrize("kind", ["few", "uniform"])
def test_work_of_exact_neighbours_is_linear(monkeypatch, kind):
    """Four times the rows are compared about four times, also where the widest feature has few values."""
    work, rng, meet = [], np.random.default_rng(4), O._meet
    monkeypatch.setattr(O, "_meet", lambda x, code, guests, hosts, *rest: work.append(len(guests) * len(hosts)) or meet(x, code, guests, hosts, *rest))
    done = []
    for n in (16_000, 64_000):
        x = np.stack((rng.integers(0, 4, n) if kind == "few" else rng.random(n), rng.random(n)), 1).astype(float)
        work.clear()
        O._search(x, np.arange(n), np.arange(n), np.arange(n), 3, 64)
        done.append(sum(work))
    assert done[1] < 6 * done[0] and done[1] < 1500 * 64_000, done
    cells = np.bincount(O._Cells(x, 16).of(x))
    assert 16 <= cells[cells > 0].min() and len(cells[cells > 0]) > 64_000 // 64


def test_places_of_many_rows(spark):
    """Two thirds of the rows are at two places: they have the smallest ids there, and no task gets them all."""
    df = spark.range(6_000).select("id", F.when(F.col("id") % 3 < 2, F.col("id") % 3).otherwise(F.rand(1) * 9).cast("double").alias("a")).repartition(8).cache()
    hosts, rest = O._places(O._points(df, "id", ["a"]), 3)
    assert hosts.count() == 2_000 + 2 * 4 and rest.count() == 3 * (4_000 - 8)
    for found in (nearest_neighbours(df, "id", ["a"], 3, 64), O.hashed_neighbours(df, "id", ["a"], 3, leaf=64)):
        got = {(r["id"], r["rank"]): r["neighbour"] for r in found.filter("id % 3 < 2").collect()}
        assert len(got) == 3 * 4_000
        for i in (0, 3, 3000, 1, 4, 3001):
            assert [got[i, rank] for rank in (1, 2, 3)] == [j for j in range(i % 3, 15, 3) if j != i][:3]


def test_coarse_buckets_of_a_sample(spark, monkeypatch):
    """Cuts from a sample of a tenth of the rows, then cuts in the tasks: bucket sizes and recall hold, and a task has a bounded number of rows."""
    monkeypatch.setattr(O, "BUCKETS", 4)
    monkeypatch.setattr(O, "SAMPLE", 1_200)
    names = ["a", "b", "c"]
    df = spark.range(12_000).select("id", *[F.rand(i + 1).alias(n) for i, n in enumerate(names)]).repartition(8).cache()
    points = O._points(df, "id", names)
    rows, levels = O._coarse(points, 3, 4, 64, 1)
    assert levels == 3 and rows.groupBy("t", "coarse", "share").count().agg(F.max("count")).first()[0] < 1_000
    sizes = O._buckets(points, 3, 4, 64, 1).groupBy("t", "node", "part").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 2 * 64 and sizes[1] == 4 * 12_000
    assert O.measured_recall(df, "id", names, O.hashed_neighbours(df, "id", names, 5, leaf=64)) >= 0.9
