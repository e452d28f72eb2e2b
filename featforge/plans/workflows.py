"""Entry points that chain operators: features to store, single-table features, selection and evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.functions.numeric import col, row_mean
from featforge.operators.impute import impute_median_mode
from featforge.operators.metrics import class_metrics, roc_auc
from featforge.operators.models import cross_val_predict, fit, null_importance, tree_importance
from featforge.operators.rows import downcast, drop_columns, split_columns
from featforge.operators.sampling import train_test_split
from featforge.operators.selection import apply_selection, importance_scores, select_features
from featforge.operators.synthesis import TRANSFORMS, EntitySet, add_transforms, combine_features, dfs
from featforge.session import cut_lineage
from featforge.sources.store import FeatureStore


def single_table_features(df: DataFrame, key: str, columns: Sequence[str] | None = None, drop: Sequence[str] = (),
                          mean_of: Sequence[str] = (), target: str | None = None,
                          trans: Sequence[str] = TRANSFORMS, threshold: float = 0.8) -> DataFrame:
    """Drop, impute, add the whole-table transforms and the row mean, then narrow the integer types.

    The transforms run over the whole table in key order. The target is never an input.
    """
    filled = impute_median_mode(drop_columns(df, drop, strict=False), threshold)
    skip = {key, target}
    inputs = [c for c in (columns or split_columns(filled)[0]) if c not in skip and c in filled.columns]
    out = add_transforms(filled, inputs, [key], trans)
    if mean_of:
        out = out.withColumn("ROW_MEAN", row_mean([c for c in mean_of if c in out.columns]))
    return downcast(out)[0]


def build_feature_set(es: EntitySet, manual: DataFrame, key: str, store: FeatureStore, name: str,
                      max_depth: int = 2, **dfs_options) -> str:
    """Manual features beside the synthesised ones, saved as a new version; returns the version."""
    automatic = dfs(es, max_depth=max_depth, **dfs_options)
    return store.save(combine_features(manual, automatic, key), name, "manual and synthesised features",
                      ["manual", "dfs"], {"max_depth": max_depth, "root": es.root})


def select_and_evaluate(df: DataFrame, features: Sequence[str], label: str, key: str, n_runs: int = 20, k: int = 5,
                        params: Mapping | None = None, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Select on the training part, cross-validate there, then score the untouched test part.

    One row: selected features, out-of-fold AUC, test AUC and test class metrics.
    """
    # Every step below reads the table again, so what it is made from is computed once.
    df = cut_lineage(df.select(*[col(c) for c in dict.fromkeys([key, label, *features])]), spread=True)
    train, test = train_test_split(df, test_fraction, key, seed, label)
    scores = importance_scores(tree_importance(train, features, label, key, params, seed),
                               null_importance(train, features, label, key, n_runs, params, seed))
    scores = cut_lineage(scores)
    chosen = {r["feature"] for r in select_features(scores).collect()}
    # With no feature selected, the best by score stand in, as for any table that lacks the selected ones.
    selected = apply_selection(train.select(*[col(f) for f in features]), sorted(chosen), scores).columns
    oof, _, _ = cross_val_predict(train, selected, label, key, k, params, seed=seed)
    scored = cut_lineage(fit(train, selected, label, key, params, seed=seed).score(test, [key, label]))
    return class_metrics(scored, label, "probability").select(
        F.lit(len(features)).alias("n_features"), F.array(*[F.lit(f) for f in selected]).alias("selected"),
        F.lit(roc_auc(oof, label, "probability").first()["auc"]).alias("oof_auc"),
        F.lit(roc_auc(scored, label, "probability").first()["auc"]).alias("test_auc"), "*")
