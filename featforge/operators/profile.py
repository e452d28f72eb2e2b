"""Profiling and data-quality reports. Reports are small tables; the data is read in one or two passes each."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featforge.functions.aggregates import safe_corr_sql
from featforge.functions.numeric import col, is_infinite, literal, quote
from featforge.operators.quantiles import most_frequent, quantile_columns, unpivot, value_table
from featforge.operators.rollup import per_column, unpivot_stats
from featforge.operators.rows import floating_columns, split_columns, string_columns


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def null_count(c: str) -> str:
    return f"count_if({c} is null)"


def row_count(_: str) -> str:
    return "count(1)"


def infinity_count(c: str) -> str:
    return f"count_if(abs({c}) = double('Infinity'))"


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percent with one decimal, most missing first."""
    found = per_column(df, df.columns, {"missing": null_count, "_n": row_count})
    return (found.where("missing > 0")
            .select("column", "missing", F.round(percent(F.col("missing"), F.col("_n")), 1).alias("percent"))
            .orderBy(F.desc("missing"), "column"))


def distinct_table(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column, n_distinct)``; exact counts shuffle by value, the approximate ones need a single pass."""
    if approx:
        return per_column(df, columns, {"n_distinct": lambda c: f"approx_count_distinct({c})"})
    counts = (unpivot(df, columns, "string").distinct().groupBy("column")
              .agg(F.count("value").alias("n_distinct")))
    return counts


def column_info(df: DataFrame, approx: bool = False) -> DataFrame:
    types = {quote(f.name): literal(f.dataType.simpleString()) for f in df.schema.fields}
    base = per_column(df, df.columns, {
        "dtype": lambda c: f"first({types[c]})", "nulls": null_count, "_n": row_count})
    return (base.join(distinct_table(df, df.columns, approx), "column", "left")
            .select("column", "dtype", "nulls", percent(F.col("nulls"), F.col("_n")).alias("null_percent"),
                    F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    columns = split_columns(df)[0] if columns is None else list(columns)
    wide = quantile_columns(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return (unpivot_stats(df, columns).join(wide, "column", "left")
            .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def box_stats(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    return quantile_columns(df, columns, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, accuracy)


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, median, std, min, max, missing count and percent, infinity count per numeric column."""
    columns = split_columns(df)[0] if columns is None else list(columns)
    floats = {quote(c) for c in floating_columns(df)}
    infinities = per_column(df, columns, {
        "infinity_count": lambda c: infinity_count(c) if c in floats else "count(null)"})
    medians = quantile_columns(df, columns, {"median": 0.5})
    return (unpivot_stats(df, columns).join(infinities, "column").join(medians, "column", "left")
            .select("column", "mean", "median", "std", "min", "max", "missing",
                    percent(F.col("missing"), F.col("missing") + F.col("count")).alias("missing_pct"),
                    "infinity_count"))


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, missing count and percent, most common value and its count per non-numeric column."""
    columns = split_columns(df)[1] if columns is None else list(columns)
    base = per_column(df, columns, {"missing": null_count, "_n": row_count})
    return (base.join(most_frequent(value_table(df, columns, "string")), "column", "left")
            .select("column", F.coalesce("n_distinct", F.lit(0)).alias("unique_values"), "missing",
                    percent(F.col("missing"), F.col("_n")).alias("missing_pct"),
                    F.col("mode").alias("most_common"), F.col("mode_count").alias("most_common_count")))


def profile(df: DataFrame, stage: str, target: str | None = None) -> DataFrame:
    """Profile of a stage as a long table ``(stage, column, metric, detail, value)``; table totals have column ''."""
    features = df if target is None else df.drop(target)
    numeric, other = split_columns(features)
    parts = []
    if numeric:
        p = profile_numeric(features, numeric)
        parts.append(_melt(p, ["mean", "median", "std", "min", "max", "missing", "missing_pct", "infinity_count"]))
    if other:
        p = profile_categorical(features, other)
        parts.append(_melt(p, ["unique_values", "missing", "missing_pct"]))
        parts.append(p.where("most_common is not null").select(
            "column", F.lit("most_common").alias("metric"), F.col("most_common").alias("detail"),
            F.col("most_common_count").cast("double").alias("value")))
    total = F.expr(" + ".join(null_count(quote(c)) for c in features.columns))
    n = F.count(F.lit(1))
    sizes = {"n_samples": n, "n_features": F.lit(len(features.columns)), "missing_total": total,
             "missing_total_pct": percent(total, n * len(features.columns))}
    summary = features.agg(F.array(*[F.struct(F.lit(m).alias("metric"), e.cast("double").alias("value"))
                                     for m, e in sizes.items()]).alias("_s"))
    parts.append(summary.select(F.explode("_s").alias("_s")).select(
        F.lit("").alias("column"), "_s.metric", F.lit("").alias("detail"), "_s.value"))
    if target is not None:
        counts = df.groupBy(col(target).cast("string").alias("detail")).count()
        classes = counts.where("detail is not null")
        if classes.limit(11).count() <= 10:
            parts.append(classes.select(F.lit(target).alias("column"), F.lit("class_count").alias("metric"), "detail",
                                        F.col("count").cast("double").alias("value")))
        parts.append(df.agg(F.expr(null_count(quote(target))).cast("double").alias("value")).select(
            F.lit(target).alias("column"), F.lit("target_missing").alias("metric"), F.lit("").alias("detail"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(stage).alias("stage"), "column", "metric", "detail", "value")


def _melt(p: DataFrame, metrics: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return p.select("column", pairs.alias("_p")).select("column", "_p.metric", F.lit("").alias("detail"), "_p.value")


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Change of the row, column and missing totals, and of mean, std, missing and distinct counts per column.

    ``status`` tells columns that only one profile has.
    """
    wanted = ["n_samples", "n_features", "missing_total", "mean", "std", "missing", "unique_values"]
    side = lambda p, n: p.where(F.col("metric").isin(wanted)).select(
        "column", "metric", F.col("value").alias(n), F.lit(True).alias(f"_{n}"))
    joined = side(a, "before").join(side(b, "after"), ["column", "metric"], "full")
    status = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("common")
    return joined.select("column", "metric", "before", "after",
                         (F.col("after") - F.col("before")).alias("change"), status.alias("status"))


def profile_series(profiles: Sequence[DataFrame]) -> DataFrame:
    """The profiles of several stages stacked, to follow a metric from stage to stage."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out


def cardinality_buckets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """low up to 5 distinct values, medium up to 20, else high."""
    columns = split_columns(df)[1] if columns is None else list(columns)
    n = F.col("n_distinct")
    return distinct_table(df, columns).select(
        "column", "n_distinct", F.when(n <= 5, "low").when(n <= 20, "medium").otherwise("high").alias("bucket"))


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 3.0) -> DataFrame:
    """Values outside ``[q1 - f*iqr, q3 + f*iqr]``, for columns with a positive iqr. Bounds are two numbers each."""
    columns = split_columns(df)[0] if columns is None else list(columns)
    finite = df.select(*[F.when(~is_infinite(c), col(c)).alias(c) if c in floating_columns(df) else col(c)
                         for c in columns])
    bounds = {}
    for r in box_stats(finite, columns).collect():
        iqr = r["q3"] - r["q1"]
        if iqr > 0:
            bounds[r["column"]] = (literal(r["q1"] - factor * iqr), literal(r["q3"] + factor * iqr))
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, outliers long")
    quoted = {quote(c): b for c, b in bounds.items()}
    return per_column(df, list(bounds), {
        "low": lambda c: f"first({quoted[c][0]})", "high": lambda c: f"first({quoted[c][1]})",
        "outliers": lambda c: f"count_if({c} < {quoted[c][0]} or {c} > {quoted[c][1]})"})


def low_variance(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.01) -> DataFrame:
    columns = split_columns(df)[0] if columns is None else list(columns)
    return (per_column(df, columns, {"variance": lambda c: f"var_samp(cast({c} as double))"})
            .where(F.col("variance") < threshold))


def quality_report(df: DataFrame) -> DataFrame:
    """Issues as ``(issue, column, value)``: missing, categorical, low variance, infinities, outliers."""
    numeric, other = split_columns(df)
    issue = lambda d, name, v: d.select(F.lit(name).alias("issue"), "column", F.col(v).cast("double").alias("value"))
    parts = [issue(missing_table(df), "missing_values", "missing")]
    if other:
        parts.append(issue(distinct_table(df, other), "categorical_features", "n_distinct"))
    if numeric:
        floats = floating_columns(df)
        parts.append(issue(low_variance(df, numeric), "low_variance", "variance"))
        if floats:
            parts.append(issue(per_column(df, floats, {"n": infinity_count}).where("n > 0"),
                               "infinity_values", "n"))
        parts.append(issue(outlier_counts(df, numeric).where("outliers > 0"), "outliers", "outliers"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_counts(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Nulls and infinities per checked column."""
    floats = {quote(c) for c in floating_columns(df)}
    names = [*columns, *([target] if target else [])]
    return per_column(df, names, {
        "nulls": null_count, "infinities": lambda c: infinity_count(c) if c in floats else "count(null)"})


def validate(df: DataFrame, columns: Sequence[str], target: str | None = None) -> None:
    """Raise when a feature has nulls or infinities, or the target has nulls."""
    bad = validate_counts(df, columns, target).where("nulls > 0 or infinities > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['column']}: {r['nulls']} nulls, {r['infinities']} infinities" for r in bad))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent per class."""
    counts = df.groupBy(col(target)).count()
    total = counts.agg(F.sum("count")).first()[0]
    return counts.withColumn("percent", percent(F.col("count"), F.lit(total)))


def corr_with(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every numeric column with the target, from one aggregate."""
    columns = split_columns(df, exclude=[target])[0] if columns is None else list(columns)
    return per_column(df, columns, {"corr": lambda c: safe_corr_sql(c.strip("`"), target)})


def histogram(df: DataFrame, column: str, bins: int = 10, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Equal-width bins over [low, high] (the observed range by default), the last one closed; empty bins count 0."""
    v = col(column).cast("double")
    if low is None or high is None:
        seen = df.where(~is_infinite(v)).agg(F.min(v), F.max(v)).first()
        low, high = (seen[0] if low is None else low), (seen[1] if high is None else high)
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    index = F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where((v >= low) & (v <= high)).groupBy(index.alias("bin")).count()
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0)).alias("n"))


def kde(df: DataFrame, column: str, by: str, grid: int = 500, bins: int | None = 20_000) -> DataFrame:
    """Gaussian density per class on an even grid over the whole range, Scott bandwidth.

    Values are first put on ``bins`` fine steps of the range, each sharing its weight between the two nearest, so that the
    work does not grow with the number of distinct values; ``bins=None`` uses every distinct value. Each value or step adds
    to every grid point inside its task, and the partial sums (classes x grid points) are all that is shuffled. A class
    of one row or without spread has no bandwidth: its density is null at every point. No values give no rows.
    """
    v = col(column).cast("double")
    rows = df.where(v.isNotNull() & col(by).isNotNull()).select(col(by).alias("_by"), v.alias("_v"))
    low, high = rows.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        return df.select(col(by), F.lit(0).alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    stats = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_std"))
    width = F.when(F.col("_std") > 0, F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    if bins and high > low:
        at = (F.col("_v") - low) / ((high - low) / bins)
        part = at - F.floor(at)
        shares = F.array(F.struct(F.floor(at).alias("i"), (1 - part).alias("w")), F.struct((F.floor(at) + 1).alias("i"), part.alias("w")))
        values = rows.select("_by", F.explode(shares).alias("_s")).groupBy("_by", F.col("_s.i").alias("_i")).agg(F.sum("_s.w").alias("_w"))
        values = values.select("_by", (F.lit(low) + F.col("_i") * ((high - low) / bins)).alias("_v"), "_w")
    else:
        values = rows.groupBy("_by", "_v").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    points = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")
    x = F.lit(low) + F.col("point") * ((high - low) / (grid - 1))
    bump = F.col("_w") * F.exp(-0.5 * F.pow((x - F.col("_v")) / F.col("_h"), 2.0))
    wide = values.join(stats.select("_by", "_n", width.alias("_h")), "_by")
    return (wide.select("_by", "_v", "_w", "_h", "_n", points)
            .groupBy("_by", "point").agg((F.sum(bump) / F.max(F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)))
                                         .alias("density"))
            .select(F.col("_by").alias(by), "point", x.alias("x"), "density"))


def normal_curve(df: DataFrame, column: str, grid: int = 100) -> DataFrame:
    """The normal density with the column's mean and std, over mean +- 4 std."""
    r = df.agg(F.avg(col(column)).alias("m"), F.stddev_samp(col(column)).alias("s")).first()
    step = 8.0 * r["s"] / (grid - 1)
    x = F.lit(r["m"] - 4 * r["s"]) + F.col("id") * step
    return df.sparkSession.range(grid).select(
        x.alias("x"), (F.exp(-0.5 * F.pow((x - r["m"]) / r["s"], 2.0)) / (r["s"] * math.sqrt(2 * math.pi))).alias("y"))


def size_report(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """Rows before and after, percent kept, and columns, per dataset."""
    parts = []
    for name, df in after.items():
        old = before[name].agg(F.count(F.lit(1)).alias("n"), F.lit("original_rows").alias("m"))
        new = df.agg(F.count(F.lit(1)).alias("n"), F.lit("current_rows").alias("m"))
        pick = lambda m: F.max(F.when(F.col("m") == m, F.col("n")))
        parts.append(old.unionByName(new).agg(pick("original_rows").alias("original_rows"),
                                              pick("current_rows").alias("current_rows"))
                     .select(F.lit(name).alias("dataset"), "original_rows", "current_rows",
                             percent(F.col("current_rows"), F.col("original_rows")).alias("percent_kept"),
                             F.lit(len(df.columns)).alias("n_columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_breakdown(df: DataFrame) -> DataFrame:
    """How many columns are numeric or categorical, original or generated (the name has a parenthesis)."""
    text = set(string_columns(df))
    rows = [("categorical" if c in text else "numeric", "generated" if "(" in c else "original") for c in df.columns]
    counts: dict = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    return df.sparkSession.createDataFrame([(k, o, n) for (k, o), n in sorted(counts.items())],
                                           "kind string, origin string, n int")

