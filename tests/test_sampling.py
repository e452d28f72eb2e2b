import math

import pytest
from pyspark.sql import functions as F

from featforge.operators import sampling as M


@pytest.fixture(scope="module")
def rows(spark):
    """Nine of ten rows are class 0."""
    return spark.range(5003).select("id", (F.col("id") % 10 == 3).cast("int").alias("y")).cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("n", [0, 1, 77, 5002, 5003, 9999])
def test_sample_n_is_exact(rows, n):
    assert len(ids(M.sample_n(rows, n, "id"))) == min(n, 5003)


def test_same_rows_for_any_partitioning(rows):
    draws = [ids(M.sample_stratified(rows.repartition(p), 600, "y", "id")) for p in (1, 8)]
    assert draws[0] == draws[1] and len(draws[0]) == 600
    assert ids(M.sample_n(rows, 50, "id", seed=1)) != ids(M.sample_n(rows, 50, "id", seed=2))


def test_many_passes_give_the_same_cuts(rows, monkeypatch):
    """With a tiny listing limit the search has to narrow hash prefixes over several passes."""
    want = ids(M.sample_n(rows, 1234, "id"))
    monkeypatch.setattr(M, "_SMALL", 0)
    assert ids(M.sample_n(rows, 1234, "id")) == want


def test_split_is_disjoint_and_stratified(rows):
    train, test = M.train_test_split(rows, 0.2, "id", stratify="y")
    a, b = ids(train), ids(test)
    assert sorted(a + b) == list(range(5003)) and len(b) == math.ceil(5003 * 0.2)
    assert test.where("y = 1").count() == pytest.approx(0.2 * rows.where("y = 1").count(), abs=1)


@pytest.mark.parametrize("stratify", [None, "y"])
def test_folds_cover(rows, stratify):
    folds = M.assign_folds(rows, 5, "id", stratify=stratify)
    sizes = [r["count"] for r in folds.groupBy("fold", *([stratify] if stratify else [])).count().collect()]
    assert sum(sizes) == 5003 and folds.select("fold").distinct().count() == 5
    if stratify is None:
        assert max(sizes) - min(sizes) <= 1


def test_permuted_labels_keep_counts(rows):
    shuffled = M.permute_label(rows, "id", "y", seed=3, name="z")
    assert shuffled.agg(F.sum("y"), F.sum("z")).first()[0] == shuffled.agg(F.sum("z")).first()[0]
    moved = shuffled.where("y <> z").count()
    assert 0.1 * 5003 < moved < 0.25 * 5003  # 2 * 0.1 * 0.9 of the rows on average


def test_profiles(rows):
    data = {"app": rows, "other": rows.drop("y")}
    keys = {"app": "id", "other": "id"}
    drawn = M.apply_profile(data, "no such profile", keys, "app", "y", n=100)
    assert {k: d.count() for k, d in drawn.items()} == {"app": 100, "other": 100}
    assert drawn["app"].where("y = 1").count() == 10
    assert M.apply_profile(data, "Full Dataset", keys, "app", "y")["app"] is rows


@pytest.fixture(scope="module")
def wide(spark):
    """A third of the rows in one class, a null class, and many small ones."""
    label = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("id") % 97))
    return spark.range(4000).select("id", label.alias("y")).repartition(5).cache()


@pytest.mark.parametrize("small", [20_000, 3])
def test_many_classes_give_the_rows_of_brute_force(wide, monkeypatch, small):
    """The cuts of a table, found in one round or in several, against ranks counted here."""
    monkeypatch.setattr(M, "_SMALL", small)
    rows = [(r.id, r.y, r.h) for r in wide.select("id", "y", M.hash_order("id", 42).alias("h")).collect()]
    assert len({y for _, y, _ in rows}) > M._FEW_CLASSES
    groups = {}
    for i, y, h in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(y, []).append(i)
    sizes = {y: len(g) for y, g in groups.items()}
    quota = M._quotas(sizes, 700)
    assert ids(M.sample_stratified(wide, 700, "y", "id")) == sorted(i for y, g in groups.items() for i in g[:quota[y]])
    quota = M._quotas(sizes, 1200)
    test = {i for y, g in groups.items() for i in g[:quota[y]]}
    assert {r.id for r in M.add_split(wide, 0.3, "id", stratify="y").filter("split = 'test'").collect()} == test
    folds = {i: 4 * at // len(g) for g in groups.values() for at, i in enumerate(g)}
    assert {r.id: r.fold for r in M.assign_folds(wide, 4, "id", stratify="y").collect()} == folds
    labels = sorted((y for _, y, _ in rows), key=lambda y: (y is None, y))
    want = {i: y for (i, _, _), y in zip(sorted(rows, key=lambda r: r[2]), labels)}
    mixed = M.permute_label(wide, "id", "y", name="z")
    assert mixed.columns == ["id", "y", "z"] and {r.id: r.z for r in mixed.collect()} == want


def test_a_class_for_each_row(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("y")).repartition(4)
    assert M.sample_stratified(df, 100, "y", "id").count() == 100
    assert ids(M.sample_stratified(df, 3000, "y", "id")) == list(range(3000)) and ids(M.sample_stratified(df, 0, "y", "id")) == []
    assert M.assign_folds(df, 1, "id", stratify="y").filter("fold = 0").count() == 3000
    assert sorted(r.y for r in M.permute_label(df, "id", "y").collect()) == sorted(str(i) for i in range(3000))


def test_select_and_evaluate_reads_its_table_once(spark):
    """What the table is made from is computed once, however many fits follow."""
    from pyspark.sql import functions as F

    from featforge.plans.workflows import select_and_evaluate
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(200, numPartitions=4).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 3 + F.col("id") % 3).cast("double").alias("a"),
                                                  (F.col("id") % 7).cast("double").alias("b"))
    out = select_and_evaluate(df.mapInArrow(mark, df.schema), ["a", "b"], "y", "id", 1, 2, {"maxIter": 1, "maxDepth": 2}).first()
    assert out["n_features"] == 2 and seen.value == 200
