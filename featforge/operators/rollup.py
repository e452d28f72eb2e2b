"""Grouped aggregation of a child table to its parent key.

Everything for one child and key goes into a single ``groupBy.agg``: one scan, map-side partial results, one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from featforge.functions.aggregates import aggregate, aggregate_sql
from featforge.functions.numeric import as_column, col, compares_true, literal, quote
from featforge.operators.encode import OneHot
from featforge.operators.joins import attach
from featforge.operators.quantiles import most_frequent, quantile_columns, value_table
from featforge.operators.rows import split_columns
from featforge.operators.states import StatePrimitive, aggregate_states

Spec = Mapping[str, Sequence[str]]


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def grouped(df: DataFrame, keys: str | Sequence[str], exprs: Mapping[str, str]) -> DataFrame:
    """``groupBy.agg`` of named SQL texts. They travel as one struct, which the optimizer takes apart again.

    Distinct counts beside other aggregates are counted by themselves and joined: in one aggregate, the partial results of all
    the others would be shuffled for each key and distinct value, and then again for each key.
    """
    names = [quote(k) for k in _keys(keys)]
    if not exprs:
        return df.select(*names).distinct()
    alone = {n: e for n, e in exprs.items() if e.startswith("count(distinct ")}
    if names and alone and len(alone) < len(exprs):
        out = grouped(df, keys, {n: e for n, e in exprs.items() if n not in alone})
        for name, text in alone.items():
            own = grouped(df, keys, {"_n": text}).toDF(*[f"_k{i}" for i in range(len(names))], "_n")
            same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(_keys(keys))]
            out = out.join(own, same, "left").withColumn(name, F.col("_n")).drop("_n", *own.columns)
        return out.select(*names, *[quote(n) for n in exprs])
    fields = ", ".join(f"{e} as {quote(n)}" for n, e in exprs.items())
    return df.groupBy(*names).agg(F.expr(f"struct({fields})").alias("_agg")).select(*names, "_agg.*")


def spec_texts(spec: Spec, prefix: str = "", where: str | None = None) -> dict[str, str]:
    """Aggregates named ``<prefix><COLUMN>_<FN>``."""
    return {f"{prefix}{c}_{fn.upper()}": aggregate_sql(fn, c, where) for c, fns in spec.items() for fn in fns}


def group_agg(df: DataFrame, keys: str | Sequence[str], spec: Spec, prefix: str = "",
              extra: Mapping[str, str] | None = None) -> DataFrame:
    """``extra`` adds aggregates given as SQL text."""
    return grouped(df, keys, {**spec_texts(spec, prefix), **(extra or {})})


def group_agg_all(df: DataFrame, keys: str | Sequence[str], fns: Sequence[str] = ("min", "max", "mean", "sum", "var"),
                  prefix: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    numeric, _ = split_columns(df, exclude=[*_keys(keys), *exclude])
    return group_agg(df, keys, {c: fns for c in numeric}, prefix)


def group_agg_where(df: DataFrame, keys: str | Sequence[str], spec: Spec, subsets: Mapping[str, Column],
                    prefix: str = "", total: Spec | None = None) -> DataFrame:
    """Aggregates of all rows (``total``) and of subsets, in the same pass instead of one join per subset.

    A parent without rows in a subset gets null for it, as the left join of a filtered table would give.
    """
    flags = {f"_in_{i}": compares_true(c) for i, c in enumerate(subsets.values())}
    exprs = spec_texts(total if total is not None else spec, prefix)
    for flag, name in zip(flags, subsets):
        for out, text in spec_texts(spec, name, flag).items():
            counts = out.endswith(("_SUM", "_SIZE", "_COUNT", "_NUNIQUE"))
            exprs[out] = f"case when count_if({flag}) > 0 then {text} end" if counts else text
    return grouped(df.withColumns(flags), keys, exprs)


def category_share_texts(model: OneHot, prefix: str = "", suffix: str = "_MEAN") -> dict[str, str]:
    """Mean of each one-hot column, without building the one-hot table."""
    return {f"{prefix}{name}{suffix}": f"avg({e})" for name, e in model.new_columns().items()}


def category_share(df: DataFrame, keys: str | Sequence[str], model: OneHot, prefix: str = "") -> DataFrame:
    return grouped(df, keys, category_share_texts(model, prefix))


def group_mean_numeric(df: DataFrame, key: str, count_columns: Sequence[str] = (), prefix: str = "",
                       exclude: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column per key; id columns become the group's row count."""
    numeric, _ = split_columns(df, exclude=[key, *exclude])
    return grouped(df, key, {
        f"{prefix}{c}": f"cast(count({quote(c)}) as double)" if c in count_columns else aggregate_sql("mean", c)
        for c in numeric})


def two_stage_rollup(child: DataFrame, grandchild: DataFrame, child_key: str, parent_key: str, grand_spec: Spec,
                     child_spec: Spec, prefix: str = "", grand_prefix: str = "") -> DataFrame:
    """Grandchild to child, joined onto the child, then child to parent."""
    inner = group_agg(grandchild, child_key, grand_spec, grand_prefix)
    return group_agg(attach(child, inner, child_key), parent_key, child_spec, prefix)


def mean_of_means(df: DataFrame, outer: str, inner: str, value: Column | str, name: str = "mean_of_means") -> DataFrame:
    means = df.groupBy(col(inner), col(outer)).agg(F.avg(as_column(value)).alias("_m"))
    return means.groupBy(col(outer)).agg(F.avg("_m").alias(name))


def agg_columns(df: DataFrame, keys: str | Sequence[str], **columns: Column) -> DataFrame:
    """Free-form aggregate columns per key, in one pass."""
    return df.groupBy(*[col(k) for k in _keys(keys)]).agg(*[e.alias(n) for n, e in columns.items()])


def agg_where(df: DataFrame, keys: str | Sequence[str], condition: Column,
              columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Aggregates of the rows that meet a condition, one output row for every key."""
    return agg_columns(df, keys, **{n: aggregate(fn, c, condition) for n, (c, fn) in columns.items()})


def groupby_agg(df: DataFrame, keys: str | Sequence[str], fns: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """``{column: fn or [fn]}`` with names ``<column>_<fn>``."""
    return grouped(df, keys, {f"{c}_{fn}": aggregate_sql(fn, c) for c, names in fns.items()
                              for fn in ([names] if isinstance(names, str) else names)})


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    out = df.where(col(column).isNotNull()).groupBy(col(column)).count().orderBy(F.desc("count"), col(column))
    return out if n is None else out.limit(n)


def mean_by(df: DataFrame, key: str | Sequence[str], *values: str) -> DataFrame:
    return df.groupBy(*[col(k) for k in _keys(key)]).agg(*[F.avg(col(v)).alias(v) for v in values])


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, nulls, min, max, mean, std, var, median, mode, distinct values.

    One pass for the moments; one count of values serves mode and distinct count; the median is selected.
    """
    columns = split_columns(df)[0] if columns is None else list(columns)
    moments = unpivot_stats(df, columns)
    counted = most_frequent(value_table(df, columns)).select("column", "mode", F.col("n_distinct").alias("nunique"))
    medians = quantile_columns(df, columns, {"median": 0.5})
    return (moments.join(counted, "column", "left").join(medians, "column", "left")
            .withColumn("nunique", F.coalesce(F.col("nunique"), F.lit(0))))


def unpivot_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments of each column as one row, from a single global aggregate."""
    return per_column(df, columns, {
        "count": lambda c: f"count({c})", "missing": lambda c: f"count_if({c} is null)",
        "min": lambda c: f"min(cast({c} as double))", "max": lambda c: f"max(cast({c} as double))",
        "mean": lambda c: f"avg(cast({c} as double))", "std": lambda c: f"stddev_samp(cast({c} as double))",
        "var": lambda c: f"var_samp(cast({c} as double))"})


def per_column(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, Callable[[str], str]]) -> DataFrame:
    """One aggregate over the table, shown as one row per column; ``metrics`` make SQL text from a quoted name."""
    rows = ", ".join(
        "struct(" + ", ".join([f"{literal(c)} as column", *(f"{fn(quote(c))} as {m}" for m, fn in metrics.items())]) + ")"
        for c in columns)
    return df.agg(F.expr(f"array({rows})").alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")


# User-defined aggregates -------------------------------------------------------------------------------------------

def normalized_mode_count(df: DataFrame, key: str, column: str, name: str = "normalized_mode_count") -> DataFrame:
    """Share of rows that hold the most common value; nulls count in the total only. Counted by (key, value) first."""
    counts = df.groupBy(col(key), col(column).alias("_v")).count()
    best = F.max(F.when(F.col("_v").isNotNull(), F.col("count")))
    return counts.groupBy(col(key)).agg(F.try_divide(best.cast("double"), F.sum("count").cast("double")).alias(name))


def group_mode(df: DataFrame, key: str, column: str, name: str = "mode") -> DataFrame:
    """Most common value, the smallest of ties. Counted by (key, value) first."""
    counts = df.where(col(column).isNotNull()).groupBy(col(key), col(column).alias("_v")).count()
    best = counts.groupBy(col(key)).agg(
        F.min_by("_v", F.struct((-F.col("count")).alias("n"), F.col("_v"))).alias(name))
    return df.select(col(key)).distinct().join(best, key, "left")


def group_nunique(df: DataFrame, key: str, column: str, name: str = "nunique") -> DataFrame:
    """Number of distinct non-null values. Distinct by (key, value) first."""
    return df.select(col(key), col(column).alias("_v")).distinct().groupBy(col(key)).agg(F.count("_v").alias(name))


@dataclass(frozen=True)
class Primitive:
    """A registered aggregate: calling it with a Column gives the aggregate Column, cast to its output type."""

    in_types: tuple[type[DataType], ...]
    out_type: DataType
    fn: Callable[[Column], Column]

    def __call__(self, column: Column) -> Column:
        return self.fn(column).cast(self.out_type)


class PrimitiveRegistry:
    """Named aggregates with input and output types: a function from a Column to an aggregate Column, or a state in Python.

    ``primitives()`` is what ``dfs`` takes as ``custom``.
    """

    def __init__(self):
        self._items: dict[str, Primitive | StatePrimitive] = {}

    def register(self, name: str, in_types: Sequence[type[DataType]], out_type: DataType,
                 fn: Callable[[Column], Column]) -> None:
        if name in self._items:
            raise ValueError(f"primitive {name!r} exists already")
        self._items[name] = Primitive(tuple(in_types), out_type, fn)

    def register_state(self, name: str, in_types: Sequence[type[DataType]], out_type: DataType, zero: Callable[[], Any],
                       update: Callable[[Any, list], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], Any]) -> None:
        """A primitive over the raw values of a group, as a state that tasks fold and merge (see ``states``)."""
        if name in self._items:
            raise ValueError(f"primitive {name!r} exists already")
        self._items[name] = StatePrimitive(tuple(in_types), out_type, zero, update, merge, finish)

    def primitives(self) -> dict[str, Primitive | StatePrimitive]:
        return dict(self._items)

    def apply(self, df: DataFrame, keys: str | Sequence[str], name: str, columns: Sequence[str] | None = None
              ) -> DataFrame:
        """``NAME(column)`` per key for every column whose type the primitive takes."""
        made = self._items[name]
        skip = set(_keys(keys))
        chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, made.in_types) and f.name not in skip
                  and (columns is None or f.name in columns)]
        if isinstance(made, StatePrimitive):
            return aggregate_states(df, keys, {f"{name.upper()}({c})": (c, made) for c in chosen})
        exprs = [made(col(c)).alias(f"{name.upper()}({c})") for c in chosen]
        return df.groupBy(*[col(k) for k in _keys(keys)]).agg(*exprs)
