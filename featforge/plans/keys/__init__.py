"""Every operator bound to the supplied tables, with the SQL that must give the same rows.

``QUERIES`` maps a key to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds the SQL where one exists. Both sides
round floating results, because sums taken in another order differ in their last digits.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from featforge.functions.numeric import quote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_FAMILIES = ("sources", "rows", "encode", "joins", "rollup", "ordered", "synthesis", "sampling", "profile",
             "selection", "metrics", "models", "jobs")


def key(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its check."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"key {name!r} is taken")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Means of a few two-decimal numbers often end exactly on a half digit, which engines round either way. Both sides
#: multiply by this first, so such values lie clearly above the half.
NUDGE = 1.000000000003


def rounded(df: DataFrame, digits: int | Mapping[str, int] = 6, nudge: bool = False) -> DataFrame:
    """Round every double column, or those named in ``digits``; + 0.0 turns a negative zero into zero."""
    def one(f):
        name = quote(f.name)
        if not isinstance(f.dataType, T.DoubleType) or not (isinstance(digits, int) or f.name in digits):
            return name
        value = f"{name} * double('{NUDGE}')" if nudge else name
        return f"round({value}, {digits if isinstance(digits, int) else digits[f.name]}) + double('0') as {name}"
    return df.selectExpr(*[one(f) for f in df.schema.fields])


def load_all() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"featforge.plans.keys.{family}")
