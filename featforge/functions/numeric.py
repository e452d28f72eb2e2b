"""Row-wise numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name; generated feature names contain dots and parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def quote(name: str) -> str:
    """A column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A number or string as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"double('{value!r}')"
    return str(value)


def as_column(value: Column | str) -> Column:
    return col(value) if isinstance(value, str) else value


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double; null when the divisor is zero."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def positive_part(value: Column | str) -> Column:
    """The value when above zero, else 0; null counts as not above zero."""
    c = as_column(value)
    return F.when(c > 0, c).otherwise(0)


def row_mean(values: Sequence[Column | str]) -> Column:
    """Mean of the non-null values of a row; null when there is none."""
    cols = [as_column(v).cast("double") for v in values]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, count.cast("double"))


def row_max(values: Sequence[Column | str]) -> Column:
    cols = [as_column(v) for v in values]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def row_null_count(values: Sequence[Column | str]) -> Column:
    return reduce(lambda a, b: a + b, [as_column(v).isNull().cast("int") for v in values])


def is_infinite(value: Column | str) -> Column:
    return F.abs(as_column(value)) == F.lit(float("inf"))


def to_int_trunc(value: Column | str) -> Column:
    """Integer part, toward zero; null when it does not fit."""
    return as_column(value).try_cast("int")


def compares_true(condition: Column) -> Column:
    """A comparison with null counts as false, not as unknown."""
    return F.coalesce(condition, F.lit(False))
