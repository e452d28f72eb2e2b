"""Hand-worked answers for the composite jobs, selection, metrics, the store and the models."""

import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from featforge.operators import correlation as C
from featforge.operators import metrics as V
from featforge.operators import models as L
from featforge.operators import rollup as A
from featforge.operators import selection as S
from featforge.operators import synthesis as D
from featforge.operators.encode import rollup_encoded
from featforge.plans.credit import manual_features
from featforge.sources.files import TableSource, load_datasets, read_csv, write_csv, write_predictions
from featforge.sources.store import FeatureStore


def test_manual_features(spark):
    app = spark.createDataFrame(
        [(1, 100000.0, 5000.0, 50000.0, -10000, -1000), (2, 200000.0, 10000.0, 70000.0, -15000, -2000),
         (3, 150000.0, 7500.0, 60000.0, -12000, -1500), (4, 300000.0, 15000.0, 90000.0, -18000, -3000),
         (5, 250000.0, 12500.0, 80000.0, -14000, -2500)],
        "SK_ID_CURR long, AMT_CREDIT double, AMT_ANNUITY double, AMT_INCOME_TOTAL double, DAYS_BIRTH int, DAYS_EMPLOYED int"
    ).withColumns({f"EXT_SOURCE_{i}": F.lit(0.1 * i) for i in (1, 2, 3)})
    bureau = spark.createDataFrame(
        [(1, "Active", -100, -50), (1, "Closed", -200, -100), (2, "Active", -150, -75), (3, "Active", -300, -150),
         (4, "Closed", -250, -125)], "SK_ID_CURR long, CREDIT_ACTIVE string, DAYS_CREDIT int, DAYS_CREDIT_ENDDATE int")
    paid = spark.createDataFrame(
        [(1, 5000.0, 5000.0, -30, -25), (1, 6000.0, 5500.0, -60, -65), (2, 7000.0, 7000.0, -30, -28),
         (3, 8000.0, 7500.0, -60, -55), (4, 9000.0, 9000.0, -30, -30)],
        "SK_ID_CURR long, AMT_INSTALMENT double, AMT_PAYMENT double, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int")
    out = manual_features(app, bureau, None, paid).orderBy("SK_ID_CURR")
    columns = ["credit_income_ratio", "credit_term", "active_loans_count", "closed_loans_count", "avg_credit_duration",
               "late_payment_ratio", "avg_payment_installment_ratio"]
    want = [(2.0, 20, 1, 1, -75, 0.5, 0.958333), (2.857143, 20, 1, None, -75, 1.0, 1.0), (2.5, 20, 1, None, -150, 1.0, 0.9375),
            (3.333333, 20, None, 1, -125, 0.0, 1.0), (3.125, 20, None, None, None, None, None)]
    for got, row in zip(out.select(*columns).collect(), want):
        assert [None if g is None else pytest.approx(g, abs=1e-6) for g in got] == list(row)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "p double, y int")
    assert V.roc_auc(df, "y", "p").first()["auc"] == 0.875
    cells = {(r["actual"], r["predicted"]): r["n"] for r in V.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    one_class = df.withColumn("y", F.lit(1))
    assert V.roc_auc(one_class, "y", "p").first()["auc"] == 0.5
    assert L.majority_baseline(one_class, "y") == {"auc": 0.5, "accuracy": 1.0, "n_classes": 1.0}
    nothing = V.class_metrics(df.where("y = 0"), "y", "p").first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0.0, 0.0, 0.0)


def test_auc_equals_evaluator(spark):
    df = spark.range(2000).select(((F.col("id") * 37 % 101) / 101).alias("p"), (F.col("id") * 17 % 5 == 0).cast("double").alias("y"))
    want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert V.roc_auc(df, "y", "p").first()["auc"] == pytest.approx(want, abs=1e-9)


def test_importance_score(spark):
    actual = spark.createDataFrame([("a", 8.0, 8.0), ("b", 2.0, 2.0)], "feature string, importance_split double, importance_gain double")
    null = spark.createDataFrame([("a", float(i), float(i), i) for i in (1, 2, 3, 4)],
                                 "feature string, importance_split double, importance_gain double, run int")
    out = {r["feature"]: r["gain_score"] for r in S.importance_scores(actual, null).collect()}
    assert out["a"] == pytest.approx(math.log(8 / 4.25), abs=1e-6) and out["b"] == 2.0


def test_too_many_features_keep_the_best_quarters(spark):
    scores = spark.createDataFrame([(f"f{i:02d}", float(i), float(19 - i)) for i in range(20)],
                                   "feature string, split_score double, gain_score double")
    got = {r["feature"] for r in S.select_features(scores, -1.0, -1.0).collect()}
    assert got == {f"f{i:02d}" for i in (0, 1, 2, 3, 4, 15, 16, 17, 18, 19)}
    # Nothing in common: the best max(20 %, min(10, 3)) = 3 features are f19, f18 and f17; the table has the first.
    wide = spark.createDataFrame([(1, 2, 3)], "f00 int, f19 int, other int")
    assert S.apply_selection(wide, ["nope"], scores).columns == ["f19"]
    assert S.apply_selection(wide, ["f19"]).columns == ["f19"]


def test_rollup_of_encoded_scores(spark):
    df = spark.createDataFrame([("c_x", 1.0), ("c_y", 2.0), ("d", 4.0)], "feature string, importance double")
    got = {r[0]: r[1] for r in rollup_encoded(df, {"c_x": "c", "c_y": "c"}).collect()}
    assert got == {"c": 3.0, "d": 4.0}


def test_correlated_columns(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"),
                                 ((F.col("id") * 7919) % 101).cast("double").alias("c"), F.lit(5.0).alias("constant"),
                                 F.when(F.col("id") < 3, F.col("id") * 1.0).alias("few"))
    assert C.correlated_columns(df) == ["b", "few"]
    assert C.drop_correlated(df).columns == ["a", "c", "constant"]
    pairs = {(r["a"], r["b"]): r["corr"] for r in C.corr_pairs(df).collect()}
    assert pairs[("a", "constant")] is None and len(pairs) == 10


def test_primitive_registry_and_mode(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, None)], "k int, v string")
    assert {r[0]: r[1] for r in A.normalized_mode_count(df, "k", "v").collect()} == {1: 0.5, 2: None}
    assert {r[0]: r[1] for r in A.group_mode(df, "k", "v").collect()} == {1: "a", 2: None}
    registry = A.PrimitiveRegistry()
    registry.register("size", [type(df.schema["v"].dataType)], df.schema["k"].dataType, lambda c: F.count(c))
    assert {r[0]: r[1] for r in registry.apply(df, "k", "size").collect()} == {1: 3, 2: 0}
    with pytest.raises(ValueError):
        registry.register("size", [], None, None)


def test_synthesis(spark):
    es = D.EntitySet("app")
    es.add("app", spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "app_id long, target int"), "app_id", exclude=["target"])
    es.add("loan", spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, 2, None)], "loan_id long, app_id long, amount double"), "loan_id")
    es.add("month", spark.createDataFrame([(10, 1.0), (10, 3.0), (12, 4.0)], "loan_id long, balance double"))
    es.relate("app", "app_id", "loan", "app_id").relate("loan", "loan_id", "month", "loan_id").relate("app", "app_id", "absent", "x")
    out = {r["app_id"]: r for r in D.dfs(es).collect()}
    assert out[1]["COUNT(loan)"] == 2 and out[3]["COUNT(loan)"] == 0
    assert out[1]["MEAN(loan.MAX(month.balance))"] == 3.0 and out[1]["SUM(loan.COUNT(month))"] == 2
    assert out[3]["MEAN(loan.amount)"] is None
    names = [f.name for f in D.dfs(es, features_only=True)]
    assert set(names) == set(out[1].asDict()) - {"app_id", "target"}
    assert not any("target" in n or "_id" in n for n in names)


def test_store(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.load("s")
    first = store.save(spark.range(3), "s", "ids", ["t"], {"a": 1})
    store.save(spark.range(5), "s")
    assert store.load("s").count() == 5 and store.load("s", first).count() == 3
    assert store.metadata("s", first)["metadata"] == {"a": 1}
    assert [r["num_rows"] for r in store.versions("s").collect()] == [5, 3]
    assert store.list().first()["num_versions"] == 2
    store.delete("s")
    assert store.list().count() == 0 and not (tmp_path / "s").exists()
    with pytest.raises(FileNotFoundError):
        store.versions("s")
    store.save(spark.range(1), "s")
    assert store.load("s").count() == 1


def test_csv_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "id long, p double")
    write_csv(df, str(tmp_path / "a"))
    back = read_csv(spark, str(tmp_path / "a"), "id long, p double")
    assert {r["id"]: r["p"] for r in back.collect()} == {1: None, 2: 2.5}
    registry = {"a": TableSource(str(tmp_path / "a"), "csv", "id long, p double", "id")}
    assert load_datasets(spark, registry, sample=1)["a"].count() == 1
    with pytest.raises(KeyError):
        load_datasets(spark, registry, ["b"])
    write_predictions(df, str(tmp_path / "p"), "id", "p")
    assert read_csv(spark, str(tmp_path / "p")).columns == ["id", "p"]


@pytest.fixture(scope="module")
def labelled(spark):
    x = (F.col("id") * 7919 % 1009) / 1009
    return spark.range(1500).select("id", x.alias("x"), ((F.col("id") * 31) % 17 / 17).alias("noise"),
                                    F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
                                    (x + (F.col("id") % 7) / 20 > 0.7).cast("int").alias("y"))


def test_model_lifecycle(spark, labelled, tmp_path):
    model = L.fit(labelled, ["x", "noise", "kind"], "y", "id", {"maxIter": 5, "maxDepth": 3}, validation_fraction=0.2)
    assert model.top_features(1).first()["feature"] == "x"
    scored = model.score(labelled, ["id", "y"])
    assert V.roc_auc(scored, "y", "probability").first()["auc"] > 0.9
    store = L.ModelStore(spark, str(tmp_path))
    store.save(model, "m", {"note": 1})
    again = store.load("m").score(labelled.drop("kind"), ["id"])   # a column the model knows is missing
    assert again.count() == 1500 and store.list().count() == 1


def test_out_of_fold_and_importance(labelled):
    params = {"maxIter": 3, "maxDepth": 3}
    oof, importances, scored = L.cross_val_predict(labelled, ["x", "noise"], "y", "id", 3, params, test=labelled.limit(10))
    assert oof.select("id").distinct().count() == 1500 and importances.count() == 6 and scored.count() == 10
    real = {r["feature"]: r for r in L.tree_importance(labelled, ["x", "noise", "kind"], "y", "id", params).collect()}
    null = L.null_importance(labelled, ["x", "noise", "kind"], "y", "id", 2, params)
    assert set(real) == {"x", "noise", "kind"} and null.count() == 6
    assert real["x"]["importance_gain"] > real["noise"]["importance_gain"]


def test_single_class_is_an_error(labelled):
    with pytest.raises(ValueError):
        L.fit(labelled.where("y = 1"), ["x"], "y", "id")


def test_search_stop_rule():
    assert not L.should_stop([0.3] * 9)
    assert L.should_stop([0.3] * 10)
    assert not L.should_stop([0.3] * 9 + [0.2])
    assert not L.should_stop([0.45] * 20)


def test_feature_subset_is_seeded():
    names = [f"f{i}" for i in range(10)]
    assert L.feature_subset(names, 0.5, 1) == L.feature_subset(names, 0.5, 1) and len(L.feature_subset(names)) == 5


def test_unknown_primitives_raise(spark):
    import pytest

    from featforge.operators.synthesis import EntitySet, define
    es = EntitySet("a")
    es.add("a", spark.range(2).toDF("k"), "k")
    es.add("b", spark.createDataFrame([(0, "x", 1), (0, "x", 2), (1, None, 3)], "k long, s string, id int"), "id")
    es.relate("a", "k", "b", "k")
    with pytest.raises(ValueError, match="nosuch"):
        define(es, ["mode", "nosuch", "max"])
    assert [f.name for f in define(es, ["mode", "nunique"])] == ["MODE(b.s)", "NUNIQUE(b.s)"]


def test_density_keeps_classes_without_spread(spark):
    from featforge.operators.profile import kde
    rows = [("a", float(i % 7)) for i in range(60)] + [("b", 2.0), ("b", 2.0), ("c", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {(r.g, r.point): r.density for r in kde(df, "v", "g", grid=40, bins=None).collect()}
    binned = {(r.g, r.point): r.density for r in kde(df, "v", "g", grid=40).collect()}
    assert len(exact) == len(binned) == 120
    for k, density in exact.items():
        assert (density is None) == (k[0] != "a")
        assert density is None or abs(density - binned[k]) < 1e-6
    assert kde(df.limit(0), "v", "g").count() == 0 and kde(df.filter("g = 'c'"), "v", "g", 5).count() == 5
