"""Feature selection from importance tables with one row per feature (and run). Ranks and thresholds are selected by
counting, so a table of any length never passes through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featforge.functions.numeric import col, quote
from featforge.operators.quantiles import exact_quantiles, value_at

_KINDS = ("split", "gain")


def importance_scores(actual: DataFrame, null: DataFrame) -> DataFrame:
    """``(feature, split_score, gain_score)`` with score = ln(1e-10 + actual / (1 + p75 of the permuted runs)).

    A feature without permuted runs keeps its plain importance.
    """
    real = actual.groupBy("feature").agg(*[F.avg(f"importance_{k}").alias(f"_a_{k}") for k in _KINDS])
    chance = null.groupBy("feature").agg(
        *[F.percentile(F.col(f"importance_{k}"), F.lit(0.75)).alias(f"_p_{k}") for k in _KINDS])
    score = lambda k: F.when(F.col(f"_p_{k}").isNull(), F.col(f"_a_{k}")).otherwise(
        F.ln(F.lit(1e-10) + F.col(f"_a_{k}") / (F.col(f"_p_{k}") + 1)))
    return real.join(chance, "feature", "left").select("feature", *[score(k).alias(f"{k}_score") for k in _KINDS])


def _descending(df: DataFrame, column: str, position: int) -> float | None:
    """The value at a zero-based position of the descending order, by selection instead of a sort."""
    n = df.where(col(column).isNotNull()).count()
    return value_at(df, column, n - 1 - position) if position < n else None


def value_at_rank(df: DataFrame, column: str, fraction: float, name: str | None = None) -> DataFrame:
    """One row with the value at zero-based position int(fraction * n) of a descending sort."""
    n = df.where(col(column).isNotNull()).count()
    found = _descending(df, column, int(fraction * n)) if n else None
    return df.sparkSession.createDataFrame([(None if found is None else float(found),)], f"{quote(name or column)} double")


def score_thresholds(scores: DataFrame) -> DataFrame:
    """One row ``(split_threshold, gain_threshold)``: the value at rank int(0.4 n), so the best 40 % per score pass.

    When none, under 5 % or over 90 % of the features would pass, the 80th, 90th or 67th percentile is used.
    """
    ranks = {k: value_at_rank(scores, f"{k}_score", 0.4).first()[0] for k in _KINDS}
    found = {k: -float("inf") if ranks[k] is None else ranks[k] for k in _KINDS}
    passed, n = scores.agg(F.count_if(_passes(found["split"], found["gain"])), F.count(F.lit(1))).first()
    prob = None
    if n and passed == 0:
        prob = 0.8
    elif passed < 0.05 * n:
        prob = 0.9
    elif n and passed > 0.9 * n:
        prob = 0.67
    if prob is not None:
        quantiles = exact_quantiles(scores, [f"{k}_score" for k in _KINDS], [prob])
        found = {k: quantiles[(f"{k}_score", prob)] for k in _KINDS}
    return scores.sparkSession.createDataFrame([(found["split"], found["gain"])],
                                               "split_threshold double, gain_threshold double")


def _passes(split_threshold: float, gain_threshold: float) -> Column:
    return (F.col("split_score") > split_threshold) | (F.col("gain_score") > gain_threshold)


def _best(scores: DataFrame, column: str, k: int) -> DataFrame:
    """The k features with the highest score, ties by name: a filter at the k-th value, and a limit among its ties."""
    cut = _descending(scores, column, k - 1) if k > 0 else None
    if cut is None:
        return scores.select("feature").limit(0) if k <= 0 else scores.select("feature")
    above = scores.where(F.col(column) > cut)
    ties = scores.where(F.col(column) == cut).orderBy("feature").limit(k - above.count())
    return above.select("feature").union(ties.select("feature"))


def select_features(scores: DataFrame, split_threshold: float | None = None,
                    gain_threshold: float | None = None) -> DataFrame:
    """Features above either threshold; when that is more than 75 %, the union of the best quarter by each score."""
    if split_threshold is None or gain_threshold is None:
        auto = score_thresholds(scores).first()
        split_threshold = auto[0] if split_threshold is None else split_threshold
        gain_threshold = auto[1] if gain_threshold is None else gain_threshold
    passing = scores.where(_passes(split_threshold, gain_threshold))
    sizes = scores.agg(F.count(F.lit(1)), F.count_if(_passes(split_threshold, gain_threshold))).first()
    if sizes[1] <= 0.75 * sizes[0]:
        return passing.select("feature")
    quarter = int(sizes[0] * 0.25)
    best = [_best(scores, f"{k}_score", quarter) for k in _KINDS]
    return best[0].union(best[1]).distinct()


def apply_selection(df: DataFrame, selected: Sequence[str], scores: DataFrame | None = None,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Project onto the selected features, in table order. With none in common: the best max(20 %, min(10, p)) by
    score that the table has, else all columns."""
    features = [c for c in df.columns if c not in set(keep)]
    common = [c for c in features if c in set(selected)]
    if not common and scores is not None:
        n = max(int(len(features) * 0.2), min(10, len(features)))
        best = {r["feature"] for r in
                scores.orderBy(F.desc("split_score"), F.desc("gain_score"), "feature").limit(n).collect()}
        common = [c for c in features if c in best]
    chosen = set(common or features) | set(keep)
    return df.select(*[col(c) for c in df.columns if c in chosen])


def selection_summary(scores: DataFrame, selected: DataFrame) -> DataFrame:
    """Number of features before and after, and the reduction in percent."""
    marked = scores.join(selected.withColumn("_in", F.lit(1)), "feature", "left")
    n, kept = F.count(F.lit(1)), F.count("_in")
    return marked.agg(n.alias("original"), kept.alias("selected"),
                      F.try_divide((n - kept) * 100.0, n.cast("double")).alias("reduction_percent"))


def removed_features(scores: DataFrame, selected: DataFrame) -> DataFrame:
    return scores.select("feature").subtract(selected)

