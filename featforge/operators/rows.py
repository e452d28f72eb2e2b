"""Projections and filters over whole tables."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.functions.aggregates import NUMERIC
from featforge.functions.numeric import as_column, col, is_infinite, quote, ratio

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def split_columns(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and non-numeric column names, in schema order."""
    skip = set(exclude)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]
    other = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC) and f.name not in skip]
    return numeric, other


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def replace_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Replace or append many columns in one projection."""
    kept = [exprs[c].alias(c) if c in exprs else quote(c) for c in df.columns]
    return df.select(*kept, *[e.alias(n) for n, e in exprs.items() if n not in df.columns])


def add_ratios(df: DataFrame, ratios: Mapping[str, tuple]) -> DataFrame:
    return replace_columns(df, {name: ratio(num, den) for name, (num, den) in ratios.items()})


def add_diffs(df: DataFrame, diffs: Mapping[str, tuple]) -> DataFrame:
    return replace_columns(df, {name: as_column(a) - as_column(b) for name, (a, b) in diffs.items()})


def null_sentinel(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    return replace_columns(df, {c: F.nullif(col(c), F.lit(value)) for c in columns})


def filter_not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows with this value; rows with null stay."""
    return df.where(~col(column).eqNullSafe(F.lit(value)))


def split_by_label(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.where(col(target).isNotNull()), df.where(col(target).isNull())


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Null share per column, one aggregate job; empty tables give 0."""
    columns = list(df.columns if columns is None else columns)
    row = df.agg(*[F.avg(col(c).isNull().cast("int")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] or 0.0 for i, c in enumerate(columns)}


def drop_sparse(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    shares = null_shares(df)
    return df.select(*[col(c) for c in df.columns if shares[c] <= threshold])


def drop_all_null(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if row[i] > 0])


# Characters that model libraries reject in names, and their replacement.
_SIMPLE_NAMES = str.maketrans({"{": "_", "}": "_", ":": "_", ",": "_", '"': None})


def clean_name(name: str) -> str:
    return name.translate(_SIMPLE_NAMES)


def _unique(wanted: Mapping[str, str]) -> dict[str, str]:
    """``wanted`` with numbered suffixes where several names want the same one.

    A name that is already as wanted keeps it, the others are numbered in order, past any number that is a wanted name.
    """
    kept = {n for n, w in wanted.items() if n == w}
    reserved, given = set(wanted.values()), set(kept)
    out = {}
    for name, want in wanted.items():
        new = want
        if name not in kept and want in given:
            numbers = (f"{want}_{k}" for k in itertools.count(1))
            new = next(n for n in numbers if n not in given and n not in reserved)
        given.add(new)
        out[name] = new
    return out


def strict_names(names: Sequence[str]) -> dict[str, str]:
    """Word characters only, a letter first, unique: original name -> new name. A name of no characters is ``feature``."""
    words = {n: re.sub(r"\W+", "_", n.strip()) for n in names}
    return _unique({n: (w if w[0].isalpha() else f"f{w}") if w else "feature" for n, w in words.items()})


def sanitize_names(df: DataFrame, mode: str = "simple") -> tuple[DataFrame, dict[str, str]]:
    mapping = strict_names(df.columns) if mode == "strict" else _unique({c: clean_name(c) for c in df.columns})
    return df.toDF(*[mapping[c] for c in df.columns]), mapping


def clean_infinite(df: DataFrame, policy: str = "null", columns: Sequence[str] | None = None,
                   limit: float = 1e30) -> DataFrame:
    """``null`` or ``zero`` for infinities; ``limit_zero`` also zeroes values beyond ``limit``."""
    columns = floating_columns(df) if columns is None else columns
    out = {}
    for c in columns:
        if policy == "null":
            out[c] = F.when(~is_infinite(c), col(c))
        elif policy == "zero":
            out[c] = F.when(is_infinite(c), 0.0).otherwise(col(c))
        elif policy == "limit_zero":
            out[c] = F.when(F.abs(col(c)) > limit, 0.0).otherwise(col(c))
        else:
            raise ValueError(f"unknown policy {policy!r}")
    return replace_columns(df, out)


def coerce_numeric(df: DataFrame, columns: Sequence[str], fill=None, dtype: str = "double") -> DataFrame:
    """Parse as numbers; what does not parse is null, then ``fill``, then ``dtype``."""
    out = {}
    for c in columns:
        value = col(c).try_cast("double")
        if fill is not None:
            value = F.coalesce(value, F.lit(float(fill)))
        out[c] = value.cast(dtype)
    return replace_columns(df, out)


def to_double(df: DataFrame) -> DataFrame:
    numeric, _ = split_columns(df)
    return replace_columns(df, {c: col(c).cast("double") for c in numeric})


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    seen, keep = set(), []
    for i, name in enumerate(df.columns):
        keep.append(name not in seen)
        seen.add(name)
    positional = df.toDF(*[f"_c{i}" for i in range(len(keep))])
    return positional.select(*[F.col(f"_c{i}").alias(n) for i, (n, k) in enumerate(zip(df.columns, keep)) if k])


_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
_RANGES = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))


def downcast(df: DataFrame, floats: bool = False) -> tuple[DataFrame, dict[str, object]]:
    """Narrow integer columns to the smallest type that holds their range (exclusive bounds), after one min/max job.

    Doubles become floats only on request, since that loses digits. The report gives bytes per row of the numeric
    columns before and after.
    """
    numeric = [f for f in df.schema.fields if f.dataType.simpleString() in _BYTES]
    integers = [f.name for f in numeric if isinstance(f.dataType, _INTEGERS)]
    types = {f.name: f.dataType.simpleString() for f in numeric}
    before = dict(types)
    if integers:
        row = df.agg(*[e for c in integers for e in (F.min(col(c)), F.max(col(c)))]).first()
        for i, c in enumerate(integers):
            low, high = row[2 * i], row[2 * i + 1]
            if low is None:
                continue
            for name, limit in _RANGES:
                if low > -limit and high < limit - 1 and _BYTES[name] < _BYTES[types[c]]:
                    types[c] = name
                    break
    if floats:
        types.update({c: "float" for c, t in types.items() if t == "double"})
    out = replace_columns(df, {c: col(c).cast(t) for c, t in types.items() if t != before[c]})
    old, new = sum(_BYTES[t] for t in before.values()), sum(_BYTES[t] for t in types.values())
    saved = 100.0 * (old - new) / old if old else 0.0
    return out, {"types": types, "bytes_before": old, "bytes_after": new, "percent_saved": saved}


def align_to(df: DataFrame, fitted: T.StructType, missing_text: str = "MISSING") -> DataFrame:
    """Exactly the fitted columns in the fitted order; absent ones are 0 or the missing text, extra ones go."""
    out = []
    for f in fitted.fields:
        if f.name in df.columns:
            out.append(col(f.name).cast(f.dataType).alias(f.name))
        else:
            blank = F.lit(0) if isinstance(f.dataType, NUMERIC) else F.lit(missing_text)
            out.append(blank.cast(f.dataType).alias(f.name))
    return df.select(*out)


def stringify(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).cast("string").alias(c) for c in df.columns])


def display_name(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[_\W]+", " ", name)).strip()


def fill_const(df: DataFrame, value=0) -> DataFrame:
    numeric, _ = split_columns(df)
    return df.fillna(value, subset=numeric) if numeric else df
