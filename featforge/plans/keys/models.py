"""Fits on a table with one row per customer.

Trainers differ, so fits on real features have no SQL. The keys named ``*_decided`` fit on data with one right answer: the
column ``debt`` decides the label, so folds, predictions, scores, importances and selected features follow by SQL.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from featforge.operators import models as L
from featforge.operators.sampling import PortableSeed, train_test_split
from featforge.plans.keys import key, table
from featforge.session import scratch_path

_SMALL = {"maxIter": 5, "maxDepth": 3}
FEATURES = ["n_orders", "mean_price", "max_price", "finished_share", "urgent_share", "lines", "returned_share", "c_mktsegment"]


def matrix(spark, sf_dir):
    """Customers with features of their orders and lines; the label tells who has a negative balance."""
    per_order = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(F.col("l_returnflag") == "R").alias("_returned"))
    orders = table(spark, sf_dir, "orders").join(per_order, "o_orderkey", "left")
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"),
        F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("finished_share"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent_share"),
        F.sum("_lines").alias("lines"), F.try_divide(F.sum("_returned"), F.sum("_lines")).alias("returned_share"))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return customers.join(per_customer, "c_custkey", "left")


@key("tree_importance")
def tree_importance(spark, sf_dir):
    return L.tree_importance(matrix(spark, sf_dir), FEATURES, "target", "c_custkey", _SMALL)


@key("null_importance")
def null_importance(spark, sf_dir):
    return L.null_importance(matrix(spark, sf_dir), FEATURES, "target", "c_custkey", 3, _SMALL)


@key("forward_select")
def forward_select(spark, sf_dir):
    kept = L.forward_select(matrix(spark, sf_dir), ["n_orders", "mean_price", "max_price", "returned_share"], "target",
                            "c_custkey", family="tree_gini", params={"maxDepth": 4})
    return spark.createDataFrame(kept, "feature string, auc double")


@key("fit_gbt")
def fit_gbt(spark, sf_dir):
    model = L.fit(matrix(spark, sf_dir), FEATURES, "target", "c_custkey", _SMALL, validation_fraction=0.2)
    return model.top_features(10)


@key("compare_models")
def compare_models(spark, sf_dir):
    train, test = train_test_split(matrix(spark, sf_dir), 0.2, "c_custkey", stratify="target")
    return L.compare_models(train, test, FEATURES, "target", "c_custkey", {
        "gbt": ("gbt", _SMALL), "random_forest": ("random_forest", {"numTrees": 10}), "tree_gini": ("tree_gini", {}),
        "tree_entropy": ("tree_entropy", {}), "logistic": ("logistic", {"maxIter": 10})})


@key("oof_predictions")
def oof_predictions(spark, sf_dir):
    return L.cross_val_predict(matrix(spark, sf_dir), FEATURES, "target", "c_custkey", 3, _SMALL)[0]


@key("batch_score")
def batch_score(spark, sf_dir):
    data = matrix(spark, sf_dir)
    model = L.fit(data, FEATURES, "target", "c_custkey", {"numTrees": 10}, "random_forest")
    return model.score(data, ["c_custkey"])


@key("param_search")
def param_search(spark, sf_dir):
    space = {"maxDepth": ("int", 2, 5), "subsamplingRate": ("float", 0.5, 1.0), "stepSize": ("log", 0.05, 0.5)}
    return L.search(matrix(spark, sf_dir), FEATURES, "target", "c_custkey", space, n_trials=2, k=3, fixed={"maxIter": 3})


@key("blend_mean", """
select o_custkey as c_custkey, round((a + b) / 2, 9) as probability
from (select o_custkey, avg((o_orderstatus = 'F')::int) as a, avg((o_orderstatus = 'O')::int) as b from orders group by 1)""")
def blend_mean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    parts = [orders.groupBy("c_custkey").agg(F.avg((F.col("o_orderstatus") == s).cast("int")).alias("probability")) for s in "FO"]
    return L.blend(parts, "c_custkey").select("c_custkey", F.round("probability", 9).alias("probability"))


@key("select_and_evaluate")
def select_and_evaluate(spark, sf_dir):
    from featforge.plans.workflows import select_and_evaluate as job
    return job(matrix(spark, sf_dir), FEATURES, "target", "c_custkey", n_runs=2, k=3, params=_SMALL)


_FLAGS = ["debt", "n_orders", "rest"]
_ONE_SPLIT = {"maxDepth": 1}
_PORTABLE = PortableSeed(42)


def decided(spark, sf_dir):
    """Customers whose label is told by one feature."""
    orders = table(spark, sf_dir, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).cast("double").alias("debt"), (F.col("c_acctbal") < 0).cast("int").alias("target"),
        (F.col("c_custkey") % 7).cast("double").alias("rest"))
    return customers.join(orders, "c_custkey", "left")


_LABELS = "select c_custkey, (c_acctbal < 0)::int as prediction, (c_acctbal < 0)::int::double as probability from customer"


@key("score_decided", _LABELS)
def score_decided(spark, sf_dir):
    data = decided(spark, sf_dir)
    return L.fit(data, _FLAGS, "target", "c_custkey", _ONE_SPLIT, "tree_gini").score(data, ["c_custkey"])


@key("oof_decided", """
select c_custkey, (c_acctbal < 0)::int as target, (c_acctbal < 0)::int as prediction,
       ((row_number() over (partition by c_acctbal < 0 order by md5(c_custkey || ':42')[:15]) - 1) * 3
        // count(*) over (partition by c_acctbal < 0))::int as fold
from customer""")
def oof_decided(spark, sf_dir):
    out = L.cross_val_predict(decided(spark, sf_dir), _FLAGS, "target", "c_custkey", 3, _ONE_SPLIT, "tree_entropy", seed=_PORTABLE)
    return out[0].select("c_custkey", "target", "prediction", "fold")


@key("compare_decided", """
select unnest(['gbt', 'tree_gini', 'tree_entropy']) as model, 1.0::double as auc, 1.0::double as accuracy from customer limit 3""")
def compare_decided(spark, sf_dir):
    train, test = train_test_split(decided(spark, sf_dir), 0.3, "c_custkey", _PORTABLE, stratify="target")
    out = L.compare_models(train, test, _FLAGS, "target", "c_custkey", {
        "gbt": ("gbt", {"maxIter": 2, "maxDepth": 2}), "tree_gini": ("tree_gini", {}), "tree_entropy": ("tree_entropy", {})})
    return out.select("model", "auc", "accuracy")


@key("forward_decided", "select 'debt' as feature, 1.0::double as auc from customer limit 1")
def forward_decided(spark, sf_dir):
    kept = L.forward_select(decided(spark, sf_dir), _FLAGS, "target", "c_custkey", family="tree_gini", params=_ONE_SPLIT)
    return spark.createDataFrame(kept, "feature string, auc double")


@key("importance_decided", """
select unnest(['debt', 'n_orders', 'rest']) as feature, unnest([1.0, 0.0, 0.0])::double as importance_split,
       round(unnest([4 * p * (1 - p), 0.0, 0.0]), 9) as importance_gain
from (select avg((c_acctbal < 0)::int) as p from customer)""")
def importance_decided(spark, sf_dir):
    """One tree of one split: its gain is the variance of the labels -1 and 1."""
    out = L.tree_importance(decided(spark, sf_dir), _FLAGS, "target", "c_custkey", {"maxIter": 1, "maxDepth": 1})
    return out.select("feature", "importance_split", F.round("importance_gain", 9).alias("importance_gain"))


@key("search_decided", """
select trial::int as trial, 1.0::double as auc, 0.0::double as loss, 0.0::double as best_loss from (select unnest(range(2)) as trial)""")
def search_decided(spark, sf_dir):
    space = {"maxDepth": ("int", 1, 3), "maxBins": ("choice", [16, 32])}
    out = L.search(decided(spark, sf_dir), _FLAGS, "target", "c_custkey", space, n_trials=2, k=3, family="tree_gini")
    return out.select("trial", "auc", "loss", "best_loss")


@key("l1_decided", "select 'debt' as feature from customer limit 1")
def l1_decided(spark, sf_dir):
    from featforge.operators.synthesis import l1_select
    kept = l1_select(decided(spark, sf_dir), _FLAGS, "target", strength=0.1)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@key("blend_decided", "select c_custkey, (c_acctbal < 0)::int::double as probability from customer")
def blend_decided(spark, sf_dir):
    """Every half of the features decides the label, so all models of the blend agree."""
    data = decided(spark, sf_dir)
    data = data.select("c_custkey", "target", *[F.col("debt").alias(f"debt{i}") for i in range(4)])
    out = L.fit_blend(data, data, [f"debt{i}" for i in range(4)], "target", "c_custkey", 3, _ONE_SPLIT, "tree_gini")
    return out.select("c_custkey", "probability")


@key("model_store", _LABELS)
def model_store(spark, sf_dir):
    """A model saved, found again by its name and loaded scores as before."""
    data = decided(spark, sf_dir)
    store = L.ModelStore(spark, scratch_path(spark, "models"))
    store.save(L.fit(data, _FLAGS, "target", "c_custkey", _ONE_SPLIT, "tree_gini"), "debt", {"kind": "tree"})
    return store.load("debt").score(data, ["c_custkey"])


@key("majority_baseline", """
select 0.5::double as auc, max(n) / sum(n)::double as accuracy, count(*)::double as n_classes
from (select count(*) as n from customer group by c_acctbal < 0)""")
def majority_baseline(spark, sf_dir):
    found = L.majority_baseline(decided(spark, sf_dir), "target")
    return spark.createDataFrame([(found["auc"], found["accuracy"], found["n_classes"])], "auc double, accuracy double, n_classes double")


@key("predictions_written", """
select c_custkey, (c_acctbal < 0)::int as target, (c_acctbal < 0)::int::double as probability from customer""")
def predictions_written(spark, sf_dir):
    """Predictions with their targets, written as CSV and read again."""
    from featforge.sources.files import write_predictions
    data = decided(spark, sf_dir)
    scored = L.fit(data, _FLAGS, "target", "c_custkey", _ONE_SPLIT, "tree_gini").score(data, ["c_custkey", "target"])
    path = scratch_path(spark, "predictions")
    write_predictions(scored, path, "c_custkey", target="target")
    return spark.read.csv(path, header=True, schema="c_custkey bigint, target int, probability double")


@key("null_importance_decided", """
select feature, (feature = 'debt')::int::double as real, 2::bigint as n_runs, feature = 'debt' as above_all
from (select unnest(['debt', 'n_orders', 'rest']) as feature) where (select count(*) from customer) > 0""")
def null_importance_decided(spark, sf_dir):
    """The feature that tells the label, and only it, is worth more than under any permuted label."""
    data = decided(spark, sf_dir)
    real = L.tree_importance(data, _FLAGS, "target", "c_custkey", {"maxIter": 1, "maxDepth": 1})
    null = L.null_importance(data, _FLAGS, "target", "c_custkey", 2, {"maxIter": 1, "maxDepth": 2}, seed=_PORTABLE)
    null = null.groupBy("feature").agg(F.max("importance_gain").alias("most"), F.countDistinct("run").alias("n_runs"))
    gain = F.coalesce("importance_gain", F.lit(0.0))
    told = F.round(gain / F.sum(gain).over(Window.partitionBy()), 9).alias("real")  # three features
    return real.join(null, "feature").select("feature", told, "n_runs", (gain > F.col("most")).alias("above_all"))


@key("feature_subset", "select 5::int as n_chosen, 5::int as n_known, true as in_order, 5 * count(*)::bigint as n_values from customer")
def feature_subset(spark, sf_dir):
    """Half of the features, in their order, drawn once for a seed, and the values that they have."""
    from featforge.operators.rollup import per_column
    names = [f"f{i}" for i in range(10)]
    chosen = L.feature_subset(names, 0.5, 42)
    data = table(spark, sf_dir, "customer", "c_custkey").select(*[F.col("c_custkey").alias(n) for n in names])
    held = per_column(data, chosen, {"n": lambda c: f"count({c})"}).agg(F.sum("n").alias("n_values"))
    ordered = chosen == sorted(chosen) and chosen == L.feature_subset(names, 0.5, 42)
    return held.select(F.lit(len(chosen)).alias("n_chosen"), F.lit(len(set(chosen) & set(names))).alias("n_known"), F.lit(ordered).alias("in_order"), "n_values")


@key("select_and_evaluate_decided", """
select 3::int as n_features, true as found, 1.0::double as oof_auc, 1.0::double as test_auc from customer limit 1""")
def select_and_evaluate_decided(spark, sf_dir):
    """Selection keeps the feature that tells the label, so that every fold and the untouched part are told apart."""
    from featforge.plans.workflows import select_and_evaluate as job
    out = job(decided(spark, sf_dir), _FLAGS, "target", "c_custkey", 2, 2, {"maxIter": 1, "maxDepth": 2}, seed=_PORTABLE)
    return out.select("n_features", F.array_contains("selected", "debt").alias("found"), F.round("oof_auc", 9).alias("oof_auc"),
                      F.round("test_auc", 9).alias("test_auc"))
