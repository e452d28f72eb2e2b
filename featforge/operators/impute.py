"""Imputation and cleaning. Fitted values are one constant per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.functions.numeric import col
from featforge.operators.encode import auto_encode
from featforge.operators.quantiles import median_columns, mode_columns
from featforge.operators.rows import (clean_infinite, drop_sparse, floating_columns, replace_columns, split_columns,
                                      string_columns)


def impute_median_mode(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Drop columns with a null share above the threshold, then floats get the median and strings the mode."""
    df = drop_sparse(df, threshold)
    fills: dict[str, object] = dict(median_columns(df, floating_columns(df)))
    fills.update(mode_columns(df, string_columns(df)))
    return fill_values(df, fills)


def fill_values(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return replace_columns(df, {c: F.coalesce(col(c), F.lit(v).cast(types[c]))
                                for c, v in fills.items() if c in types and v is not None})


@dataclass
class Imputer:
    """Fit on training rows, apply to any rows. ``strategy``: mean, median, most_frequent or constant."""

    strategy: str = "median"
    constant: object = 0
    text_strategy: str = "most_frequent"
    text_constant: str = "MISSING"
    values: dict[str, object] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> Imputer:
        chosen = df.select(*[col(c) for c in (columns if columns is not None else df.columns)])
        numeric, other = split_columns(chosen)
        other = [c for c in other if c in string_columns(chosen)]
        if self.strategy == "median":
            found: dict[str, object] = dict(median_columns(chosen, numeric))
        elif self.strategy == "mean":
            row = chosen.agg(*[F.avg(col(c).cast("double")) for c in numeric]).first() if numeric else []
            found = dict(zip(numeric, row))
        elif self.strategy == "most_frequent":
            found = dict(mode_columns(chosen, numeric, "double"))
        elif self.strategy == "constant":
            found = {c: self.constant for c in numeric}
        else:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        self.values = {c: 0 if found.get(c) is None else found[c] for c in numeric}
        if self.text_strategy == "constant":
            self.values.update({c: self.text_constant for c in other})
        else:
            modes = mode_columns(chosen, other)
            self.values.update({c: modes.get(c, self.text_constant) for c in other})
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Numeric columns come out as double, so a fractional mean fits an integer column."""
        numeric, _ = split_columns(df)
        out = {}
        for c, v in self.values.items():
            if c in df.columns:
                value = col(c).cast("double") if c in numeric else col(c)
                out[c] = F.coalesce(value, F.lit(float(v) if c in numeric else v))
        return replace_columns(df, out)


def repair_target(df: DataFrame, target: str, policy: str = "mode") -> DataFrame:
    """Null targets take the most common class, or the rows go."""
    if policy == "drop":
        return df.where(col(target).isNotNull())
    if policy != "mode":
        raise ValueError(f"unknown policy {policy!r}")
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("v")).count()
    best = counts.agg(F.min_by("v", F.struct((-F.col("count")).alias("n"), F.col("v")))).first()[0]
    return df if best is None else fill_values(df, {target: best})


def clean_dataset(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric matrix without nulls or infinities: encode strings, infinities to null, medians, target repair."""
    keep = [target, *exclude]
    encoded = auto_encode(df, exclude=keep)
    numeric, other = split_columns(encoded, exclude=keep)
    encoded = clean_infinite(encoded, "null", [c for c in floating_columns(encoded) if c not in keep])
    filled = Imputer("median").fit(encoded, numeric).transform(encoded)
    dropped = [c for c in other if c not in keep]
    return repair_target(filled.drop(*dropped), target)
