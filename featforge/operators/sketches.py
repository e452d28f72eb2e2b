"""Profiles that merge: one row a column with counts and sketches, so parts and stages are joined without a rescan.

A profile row holds exact counts, ends and sums, a HyperLogLog sketch of the distinct values and, for numbers, a KLL sketch of
the quantiles. Rows of other parts of a table, other days or other stages are merged by ``merge_profiles``; ``read_profiles``
turns them into numbers. Errors are stated by ``distinct_error`` and ``rank_error``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.functions.aggregates import NUMERIC
from featforge.functions.numeric import col, literal, quote

#: 2 ** LOG_REGISTERS registers of a HyperLogLog sketch, and the size parameter of a KLL sketch.
LOG_REGISTERS = 13
KLL_SIZE = 400


def distinct_error(log_registers: int = LOG_REGISTERS) -> float:
    """Relative error of a distinct count that about 99.7 % of sketches keep: three standard errors."""
    return 3 * 1.04 / 2 ** (log_registers / 2)


def rank_error(size: int = KLL_SIZE) -> float:
    """Largest distance, as a share of the rows, of a quantile's rank from the rank asked for, at a confidence of 99 %."""
    return 2.296 / size ** 0.9021


def sketch_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, rows, missing, low, high, total, distinct, quantiles)``: one pass, one row for each column (and group).

    ``low``, ``high``, ``total`` and ``quantiles`` are null for columns that are no numbers; NaN and infinite values count as
    missing. A table without rows has rows of 0, without groups none if ``by`` is given. The binary columns are sketches.
    """
    names = [c for c in df.columns if c not in set(by)] if columns is None else list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for c in names:
        number = isinstance(types[c], NUMERIC)
        value = f"cast({quote(c)} as double)"
        value = f"case when abs({value}) < double('Infinity') then {value} end" if number else quote(c)
        null = "cast(null as {})".format
        # The sketch passes over empty text, so every value gets a letter of its own.
        sketch = f"hll_sketch_agg(concat('=', cast({value} as string)), {LOG_REGISTERS})"
        parts = {"column": literal(c), "rows": "count(1)", "missing": f"count_if({value} is null)",
                 "low": f"min({value})" if number else null("double"), "high": f"max({value})" if number else null("double"),
                 "total": f"sum({value})" if number else null("double"), "distinct": sketch,
                 "quantiles": f"kll_sketch_agg_double({value}, {KLL_SIZE})" if number else null("binary")}
        rows.append("struct(" + ", ".join(f"{e} as {n}" for n, e in parts.items()) + ")")
    grouped = df.groupBy(*[col(b) for b in by]).agg(F.expr(f"array({', '.join(rows)})").alias("_p"))
    return grouped.select(*[col(b) for b in by], F.inline("_p"))


def merge_profiles(profiles: Sequence[DataFrame] | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each column (and group) from any number of profile tables, or rows of one, by their sketches alone."""
    rows = profiles if isinstance(profiles, DataFrame) else reduce(DataFrame.unionByName, profiles)
    keys = [*by, "column"]
    return rows.groupBy(*[col(k) for k in keys]).agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("total").alias("total"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"kll_merge_agg_double(quantiles, {KLL_SIZE})").alias("quantiles"))


def read_profiles(profiles: DataFrame, quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Numbers instead of sketches: ``n_distinct`` and a column for each named quantile (null where there are no values)."""
    quantiles = {"q25": 0.25, "median": 0.5, "q75": 0.75} if quantiles is None else dict(quantiles)
    known = F.col("high").isNotNull()
    values = [F.when(known, F.expr(f"kll_sketch_get_quantile_double(quantiles, {float(q)}d)")).alias(n) for n, q in quantiles.items()]
    kept = [quote(c) for c in profiles.columns if c not in ("distinct", "quantiles", "total")]
    mean = F.try_divide(F.col("total"), F.col("rows") - F.col("missing")).alias("mean")
    return profiles.select(*kept, mean, F.hll_sketch_estimate("distinct").alias("n_distinct"), *values)
