"""Evaluation of binary scores. Labels are 0/1, ``score`` is the probability of class 1.

Ranking metrics start from counts per distinct score, so ties are exact and many equal scores are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featforge.functions.numeric import col
from featforge.operators.ordered import OrderedTable


def _scored(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    y = col(label).cast("int")
    return (df.where(y.isNotNull() & col(score).isNotNull())
            .groupBy(*[col(b) for b in by], col(score).cast("double").alias("score"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def _curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: rows at or above it by class (``tp``, ``fp``), and the class totals."""
    run = OrderedTable(_scored(df, label, score, by), [-F.col("score")], by).running(
        sums={"tp": "pos", "fp": "neg"})
    totals = run.groupBy(*[col(b) for b in by]).agg(F.max("tp").alias("p_total"), F.max("fp").alias("n_total"))
    if by:
        return run.join(totals, list(by))
    t = totals.first()
    return run.withColumns({"p_total": F.lit(t["p_total"]).cast("long"), "n_total": F.lit(t["n_total"]).cast("long")})


def _auc_expr() -> Column:
    """From running sums by descending score: pairs won, half of the tied pairs included."""
    pairs = F.max("tp").cast("double") * F.max("fp").cast("double")
    won = pairs + F.sum(F.col("pos") * (F.col("neg") * 0.5 - F.col("fp")))
    return F.coalesce(F.try_divide(won, pairs), F.lit(0.5))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve, per group if given; 0.5 when only one class is present."""
    run = OrderedTable(_scored(df, label, score, by), [-F.col("score")], by).running(sums={"tp": "pos", "fp": "neg"})
    return run.groupBy(*[col(b) for b in by]).agg(_auc_expr().alias(name))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score; the curve starts at the implied point (0, 0)."""
    c = _curve(df, label, score, by)
    return c.select(*[col(b) for b in by], F.col("score").alias("threshold"),
                    F.try_divide(F.col("fp").cast("double"), F.col("n_total").cast("double")).alias("fpr"),
                    F.try_divide(F.col("tp").cast("double"), F.col("p_total").cast("double")).alias("tpr"))


def roc_on_grid(df: DataFrame, label: str, score: str, fold: str, grid: int = 100) -> DataFrame:
    """Mean ROC curve: each fold's curve interpolated at ``grid`` false-positive rates, then averaged.

    A curve segment covers a range of grid points, so each segment emits its own points and no range join is needed.
    """
    last = grid - 1
    # Several scores can share a false-positive rate; the highest true-positive rate stands for it.
    steps = (roc_curve(df, label, score, [fold]).groupBy(col(fold).alias("_fold"), F.col("fpr"))
             .agg(F.max("tpr").alias("tpr")))
    run = OrderedTable(steps, ["fpr"], ["_fold"]).running(lags={"_x0": "fpr", "_y0": "tpr"})
    x0, y0 = F.coalesce("_x0", F.lit(0.0)), F.coalesce("_y0", F.lit(0.0))
    lo, hi = F.ceil(x0 * last).cast("int"), (F.ceil(F.col("fpr") * last) - 1).cast("int")
    x = F.col("point") / F.lit(float(last))
    inside = (run.withColumns({"_a": x0, "_b": y0}).where((F.col("fpr") > F.col("_a")) & (lo <= hi))
              .withColumn("point", F.explode(F.sequence(lo, hi)))
              .select("_fold", "point", F.when(F.col("point") == 0, 0.0).otherwise(
                  F.col("_b") + (F.col("tpr") - F.col("_b")) * F.try_divide(x - F.col("_a"), F.col("fpr") - F.col("_a"))
              ).alias("tpr")))
    ends = steps.groupBy("_fold").agg(F.max("tpr").alias("tpr")).select("_fold", F.lit(last).alias("point"), "tpr")
    return (inside.unionByName(ends).groupBy("point").agg(F.avg("tpr").alias("mean_tpr"))
            .select("point", (F.col("point") / F.lit(float(last))).alias("fpr"), "mean_tpr"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, precision, recall)`` for every distinct score; the implied last point is (1, 0)."""
    c = _curve(df, label, score)
    return c.select(F.col("score").alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide(F.col("tp").cast("double"), F.col("p_total").cast("double")).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    run = OrderedTable(_scored(df, label, score, ()), [-F.col("score")]).running(sums={"tp": "pos", "fp": "neg"})
    gained = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return run.agg(F.try_divide(gained, F.max("tp").cast("double")).alias("average_precision"))


def _cells(label: str, predicted: Column) -> dict[str, Column]:
    y = col(label).cast("int") == 1
    return {"tp": F.count_if(y & predicted), "fp": F.count_if(~y & predicted),
            "fn": F.count_if(y & ~predicted), "tn": F.count_if(~y & ~predicted)}


def _counts(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    return df.agg(*[e.alias(n) for n, e in _cells(label, col(score) >= threshold).items()])


def _zero_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def class_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1; a zero divisor gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _counts(df, label, score, threshold).select(
        _zero_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _zero_ratio(tp, tp + fp).alias("precision"),
        _zero_ratio(tp, tp + fn).alias("recall"), _zero_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """The four cells ``(actual, predicted, n)``, empty ones included."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
                     for a, p, c in cells])
    return _counts(df, label, score, threshold).select(F.explode(rows).alias("r")).select("r.*")


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, f1 and support per class, with macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = (_zero_ratio(tp, tp + fp), _zero_ratio(tp, tp + fn), _zero_ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    zero = (_zero_ratio(tn, tn + fn), _zero_ratio(tn, tn + fp), _zero_ratio(2 * tn, 2 * tn + fp + fn), tn + fp)
    total = one[3] + zero[3]
    macro = tuple((a + b) / 2 for a, b in zip(zero[:3], one[:3])) + (total,)
    weighted = tuple(_zero_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])) + (total,)
    rows = F.array(*[
        F.struct(F.lit(n).alias("class"), r[0].alias("precision"), r[1].alias("recall"), r[2].alias("f1"),
                 r[3].alias("support"))
        for n, r in (("0", zero), ("1", one), ("macro avg", macro), ("weighted avg", weighted))])
    return _counts(df, label, score, threshold).select(F.explode(rows).alias("r")).select("r.*")


def fold_summary(df: DataFrame, label: str, score: str, fold: str) -> DataFrame:
    """Mean and population standard deviation of the fold AUCs, beside the AUC over all rows."""
    folds = roc_auc(df, label, score, [fold])
    overall = roc_auc(df, label, score).first()["auc"]
    return folds.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
                     F.lit(overall).alias("overall_auc"))
