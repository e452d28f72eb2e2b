"""Aggregate expressions; all of them have a partial (map-side) form, so hot keys shrink before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.functions.numeric import as_column, compares_true, quote, ratio


def only(condition: Column | None, value: Column) -> Column:
    """``value`` on the rows that meet ``condition``, null elsewhere: an aggregate FILTER clause."""
    return value if condition is None else F.when(condition, value)


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


#: Aggregate functions by name. ``sum`` of only nulls is 0 and ``size`` counts nulls.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "mean": lambda c: F.avg(c.cast("double")),
    "sum": _sum,
    "var": lambda c: F.var_samp(c.cast("double")),
    "std": lambda c: F.stddev_samp(c.cast("double")),
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "nunique": F.count_distinct,
}


def aggregate(fn: str, value: Column | str, condition: Column | None = None) -> Column:
    """One named aggregate, optionally over the rows that meet ``condition`` only."""
    c = as_column(value)
    if fn == "size":
        return F.count(F.lit(1)) if condition is None else F.count_if(compares_true(condition))
    if fn not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {fn!r}; known: {sorted(FUNCTIONS)}")
    return FUNCTIONS[fn](only(condition, c))


#: The same functions as SQL text, for plans with hundreds of aggregates: text is parsed in one call, while every
#: step of a Column costs round trips to the JVM.
_TEXT = {
    "min": "min({c}){w}",
    "max": "max({c}){w}",
    "mean": "avg(cast({c} as double)){w}",
    "sum": "coalesce(sum({c}){w}, 0)",
    "var": "var_samp(cast({c} as double)){w}",
    "std": "stddev_samp(cast({c} as double)){w}",
    "count": "count({c}){w}",
    "size": "count(1){w}",
    "nunique": "count(distinct {c}){w}",
}


def aggregate_sql(fn: str, column: str | None, where: str | None = None) -> str:
    """SQL text of one named aggregate of a column, optionally over the rows that meet ``where``."""
    if fn not in _TEXT:
        raise ValueError(f"unknown aggregate {fn!r}; known: {sorted(_TEXT)}")
    return _TEXT[fn].format(c=quote(column) if column is not None else "1", w=f" filter (where {where})" if where else "")


def safe_corr_sql(a: str, b: str) -> str:
    """``safe_corr`` as SQL text."""
    x = f"case when {quote(b)} is not null then cast({quote(a)} as double) end"
    y = f"case when {quote(a)} is not null then cast({quote(b)} as double) end"
    return (f"case when min({x}) < max({x}) and min({y}) < max({y}) "
            f"then try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y})) end")


def ratio_of_sums(num: Column | str, den: Column | str) -> Column:
    return ratio(F.sum(as_column(num)), F.sum(as_column(den)))


def mean_ratio(num: Column | str, den: Column | str) -> Column:
    """Mean of the row ratios; rows with a zero divisor do not count."""
    return F.avg(ratio(num, den))


def last_by(value: Column | str, *order: Column | str) -> Column:
    """Last non-null value in the given order (end the order with a unique column to settle ties)."""
    v = as_column(value)
    key = F.struct(*[as_column(o) for o in order])
    return F.max_by(v, F.when(v.isNotNull(), key))


def share_true(condition: Column) -> Column:
    return F.avg(compares_true(condition).cast("double"))


def percent_true(value: Column | str) -> Column:
    """Share of true among all rows, nulls counted as false."""
    return share_true(as_column(value).cast("boolean"))


def count_ratio(condition: Column) -> Column:
    """Share of rows that meet the condition; null rather than 0 when none does."""
    return ratio(F.nullif(F.count_if(compares_true(condition)), F.lit(0)), F.count(F.lit(1)))


def trend(value: Column | str, time: Column | str, unit_seconds: float = 86400.0) -> Column:
    """Slope of the value over time in days (or raw units for numeric time); null under two distinct times."""
    v, t = as_column(value).cast("double"), as_column(time)
    both = v.isNotNull() & t.isNotNull()
    x = F.when(both, t.cast("double") / F.lit(unit_seconds))
    y = F.when(both, v)
    return F.when(F.min(x) < F.max(x), ratio(F.covar_pop(y, x), F.var_pop(x)))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the pairs without nulls; null when either side is constant."""
    x, y = as_column(a).cast("double"), as_column(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    varied = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varied, ratio(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys)))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
