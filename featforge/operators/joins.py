"""Joins, unions and set operations. Spark picks broadcast or sort-merge from run-time sizes; nothing is hinted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.functions.numeric import col

JOIN_TYPES = ("inner", "left", "right", "outer")


def attach(parent: DataFrame, child: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join of a per-key table onto its parent."""
    return parent.join(child, [key] if isinstance(key, str) else list(key), "left")


def assemble(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Base left-joined to per-key tables. Each part is already partitioned by the key, so the base shuffles once."""
    return reduce(lambda left, part: attach(left, part, key), parts, base)


def merge_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                 suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on equal key names; other names that clash get a suffix on each side."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    rename = lambda df, s: df.toDF(*[c + s if c in clash else c for c in df.columns])
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), list(on), how)


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: str | Sequence[str] | None = None,
          left_on: str | None = None, right_on: str | None = None,
          suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join with equal or different key names; both key columns stay when the names differ."""
    if how not in JOIN_TYPES:
        raise ValueError(f"join type {how!r} is not one of {JOIN_TYPES}")
    if on is not None:
        return merge_suffix(left, right, [on] if isinstance(on, str) else list(on), how, suffixes)
    if left_on is None or right_on is None:
        raise ValueError("give either on, or left_on and right_on")
    clash = set(left.columns) & set(right.columns)
    names_l = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    names_r = {c: c + suffixes[1] if c in clash else c for c in right.columns}
    a, b = left.toDF(*names_l.values()), right.toDF(*names_r.values())
    return a.join(b, a[f"`{names_l[left_on]}`"] == b[f"`{names_r[right_on]}`"], how)


def map_lookup(df: DataFrame, key: str, values: Mapping[str, object]) -> DataFrame:
    """Per-key aggregates written back on every row. Aggregate and join, not a window: a hot key keeps many tasks."""
    per_key = df.groupBy(col(key)).agg(*[e.alias(n) for n, e in values.items()])
    return attach(df, per_key, key)


def group_count_back(df: DataFrame, key: str, name: str = "count", column: str | None = None) -> DataFrame:
    return map_lookup(df, key, {name: F.count(F.lit(1) if column is None else col(column))})


def attach_target(features: DataFrame, labelled: DataFrame, key: str, target: str) -> DataFrame:
    return attach(features.drop(target), labelled.select(col(key), col(target)), key)


def keep_in(df: DataFrame, wanted: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(wanted, [key] if isinstance(key, str) else list(key), "left_semi")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(col(key)).distinct().join(b.select(col(key)), key, "left_semi")


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two tables; a column that one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def top_k(df: DataFrame, by: str, k: int, ascending: bool = False, tiebreak: Sequence[str] = ()) -> DataFrame:
    """k best rows: each task keeps its k best before the merge."""
    first = F.asc(f"`{by}`") if ascending else F.desc(f"`{by}`")
    return df.orderBy(first, *[col(t) for t in tiebreak]).limit(k)


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[col(o) for o in order_by]).limit(n)
