"""Exact quantiles, value counts and modes of whole columns.

Spark's own ``percentile`` keeps every distinct value of a group in one task. Exact quantiles are found here by
selection instead: a quantile sketch brackets each wanted rank, a counting pass tells how many values lie below, on and
inside the ends of the bracket, and the bracket shrinks by a factor of thousands per round until its values can be listed.
A rank among the values equal to an end is found at once, and else both ends move inside, so every round shrinks the
bracket however often a value repeats. Each pass is a global aggregate without a shuffle of rows. Ranks are whole numbers
and values keep their type, so neither rounds.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.functions.numeric import col, literal, quote

_ACCURACY = 10_000      # rank error of one sketch: 1 / accuracy of the rows it saw
_LISTED = 20_000        # values of one bracket that are listed; wider brackets shrink first, with the same result
_COLUMNS_PER_JOB = 40   # a job reads only its own columns, so more columns mean more jobs, not more input


def unpivot(df: DataFrame, columns: Sequence[str], cast: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., column, value)``."""
    pairs = ", ".join(f"struct({literal(c)} as column, cast({quote(c)} as {cast}) as value)" for c in columns)
    kept = [quote(k) for k in keep]
    return df.selectExpr(*kept, f"explode(array({pairs})) as _p").selectExpr(*kept, "_p.column", "_p.value")


def value_table(df: DataFrame, columns: Sequence[str], cast: str = "double") -> DataFrame:
    """``(column, value, exact, n)``: how often each non-null value occurs in each column.

    ``exact`` is the text of a value that the cast may round (long and decimal numbers as double), else null.
    """
    wide = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DecimalType))} if cast == "double" else set()
    pairs = ", ".join(f"struct({literal(c)} as column, cast({quote(c)} as {cast}) as value, "
                      f"{f'cast({quote(c)} as string)' if c in wide else 'cast(null as string)'} as exact)" for c in columns)
    long = df.selectExpr(f"explode(array({pairs})) as _p").selectExpr("_p.column", "_p.value", "_p.exact")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value", "exact").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class _Bracket:
    """Values ``low..high`` known to hold the wanted 0-based rank; ``below`` counts the values under ``low``."""

    column: str
    rank: int
    low: object
    high: object
    below: int = 0
    inside: int = 0


def _aggregate(df: DataFrame, exprs: list) -> tuple:
    return df.agg(*[e.alias(f"a{i}") for i, e in enumerate(exprs)]).first()


def _count(df: DataFrame, brackets: list[_Bracket], around: list[_Bracket], found: dict) -> list[_Bracket]:
    """Resolve brackets whose rank falls on an end, move the ends of the others inside; returns those left.

    A bracket that does not hold its rank, because a sketch missed, is replaced by the side of the one around it that does.
    """
    exprs = []
    for b in brackets:
        v, low, high = F.col(b.column), F.lit(b.low), F.lit(b.high)
        exprs += [F.count_if(v < low), F.count_if(v == low), F.count_if(v < high), F.count_if(v == high),
                  F.min(F.when(v > low, v)), F.max(F.when(v < high, v)), F.max(F.when(v < low, v)), F.min(F.when(v > high, v))]
    row, left = _aggregate(df, exprs), []
    for i, b in enumerate(brackets):
        under, on_low, under_high, on_high, after, before, smaller, larger = row[8 * i:8 * i + 8]
        a, past = around[i], under_high + on_high
        if under <= b.rank < under + on_low:
            found[(b.column, b.rank)] = b.low
        elif under_high <= b.rank < under_high + on_high:
            found[(b.column, b.rank)] = b.high
        elif b.rank < under:
            left.append(_Bracket(b.column, b.rank, a.low, smaller, a.below, under - a.below))
        elif b.rank >= past:
            left.append(_Bracket(b.column, b.rank, larger, a.high, past, a.below + a.inside - past))
        else:
            left.append(_Bracket(b.column, b.rank, after, before, under + on_low, under_high - under - on_low))
    return left


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Brackets around the ranks from a sketch of the values inside the given ones."""
    margin, exprs = 2.0 / _ACCURACY, []
    for b in brackets:
        q = (b.rank - b.below) / max(b.inside - 1, 1)
        held = F.when(F.col(b.column).between(F.lit(b.low), F.lit(b.high)), F.col(b.column))
        exprs.append(F.percentile_approx(held, [max(q - margin, 0.0), min(q + margin, 1.0)], _ACCURACY))
    # A sketch rounds long and decimal values, so its ends may lie just outside.
    return [_Bracket(b.column, b.rank, low if low > b.low else b.low, high if high < b.high else b.high)
            for b, (low, high) in zip(brackets, _aggregate(df, exprs))]


def _list(df: DataFrame, brackets: list[_Bracket], found: dict) -> None:
    """The value at each rank, from the counted values of the small brackets; long and decimal numbers travel as text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for start in range(0, len(brackets), 64):
        part = brackets[start:start + 64]
        hits = []
        for i, b in enumerate(part):
            plain = isinstance(kinds[b.column], T.DoubleType)
            value = F.struct(F.lit(i).alias("b"), (F.col(b.column) if plain else F.lit(None)).cast("double").alias("v"),
                             (F.lit(None) if plain else F.col(b.column)).cast("string").alias("t"))
            hits.append(F.when(F.col(b.column).between(F.lit(b.low), F.lit(b.high)), value))
        rows = (df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
                .groupBy("h.b", "h.v", "h.t").agg(F.count(F.lit(1)).alias("n")).collect())
        values: dict[int, list] = {}
        for i, v, t, n in rows:
            parse = Decimal if isinstance(kinds[part[i].column], T.DecimalType) else int
            values.setdefault(i, []).append((v if t is None else parse(t), n))
        for i, b in enumerate(part):
            left = b.rank - b.below
            for v, n in sorted(values[i], key=lambda x: (x[0] != x[0], x[0])):
                if left < n:
                    found[(b.column, b.rank)] = v
                    break
                left -= n


def values_at(df: DataFrame, ranks: Mapping[str, Collection[int]]) -> dict[tuple[str, int], object]:
    """``{(column, rank): value}`` at zero-based ranks of the ascending order of each column's non-null values.

    Values keep the type of their column. Ranks outside of a column are absent.
    """
    found: dict[tuple[str, int], object] = {}
    columns = list(ranks)
    for start in range(0, len(columns), _COLUMNS_PER_JOB):
        some = columns[start:start + _COLUMNS_PER_JOB]
        part = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(some)])
        names = {f"c{i}": c for i, c in enumerate(some)}
        got = _values_at(part, {f"c{i}": sorted(ranks[c]) for i, c in enumerate(some)})
        found.update({(names[c], r): v for (c, r), v in got.items()})
    return found


def _values_at(df: DataFrame, ranks: dict[str, list[int]]) -> dict:
    row = _aggregate(df, [e for c in ranks for e in (F.count(c), F.min(c), F.max(c))])
    bounds = {c: (row[3 * i + 1], row[3 * i + 2], row[3 * i]) for i, c in enumerate(ranks)}
    found: dict = {}
    pending = []
    for c, wanted in ranks.items():
        low, high, n = bounds[c]
        for r in wanted:
            if r in (0, n - 1) and n:  # the extremes are known without a search
                found[(c, r)] = low if r == 0 else high
            elif 0 < r < n - 1:
                pending.append(_Bracket(c, r, low, high, 0, n))
    while pending:
        small = [b for b in pending if b.inside <= _LISTED]
        _list(df, small, found)
        wide = [b for b in pending if b.inside > _LISTED]
        if not wide:
            break
        pending = _count(df, _narrow(df, wide), wide, found)
        old = {(b.column, b.rank): b.inside for b in wide}
        if any(b.inside >= old[(b.column, b.rank)] for b in pending):
            raise AssertionError("a bracket did not shrink")
    return found


def _position(p: float, n: int) -> Fraction:
    """Zero-based position of a quantile among n values, without rounding; p counts as the decimal number it is written as."""
    return Fraction(repr(float(p))) * (n - 1)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """``{(column, prob): value}`` with linear interpolation; columns without values are absent."""
    if not columns:
        return {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    exact = (T.IntegralType, T.DecimalType, T.DoubleType)
    df = df.select(*[col(c) if isinstance(kinds[c], exact) else col(c).cast("double").alias(c) for c in columns])
    counts = _aggregate(df, [F.count(col(c)) for c in columns])
    at = {(c, p): _position(p, n) for c, n in zip(columns, counts) if n for p in probs}
    ranks: dict[str, set[int]] = {}
    for (c, _), x in at.items():
        ranks.setdefault(c, set()).update((math.floor(x), math.ceil(x)))
    value, out = values_at(df, ranks), {}
    for (c, p), x in at.items():
        low, high = value[(c, math.floor(x))], value[(c, math.ceil(x))]
        out[(c, p)] = float(low) if low == high else float(low) + (float(high) - float(low)) * float(x - math.floor(x))
    return out


def value_at(df: DataFrame, column: str, rank: int) -> object:
    """The value at a zero-based rank of the ascending order of a column, null beyond it."""
    return values_at(df, {column: [rank]}).get((column, rank))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """``(column, prob, quantile)``; exact unless ``accuracy`` asks for the one-pass sketch."""
    probs = [float(p) for p in probs]
    if accuracy is None:
        rows = [(c, p, v) for (c, p), v in exact_quantiles(df, columns, probs).items()]
    else:
        row = _aggregate(df, [F.percentile_approx(col(c).cast("double"), probs, accuracy) for c in columns])
        rows = [(c, p, v) for c, vs in zip(columns, row) if vs is not None for p, v in zip(probs, vs)]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, quantile double")


def quantile_columns(df: DataFrame, columns: Sequence[str], names: dict[str, float],
                     accuracy: int | None = None) -> DataFrame:
    """One row per column with the named quantiles as columns."""
    q = quantiles(df, columns, list(names.values()), accuracy)
    return q.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                                     for n, p in names.items()])


def most_frequent(values: DataFrame) -> DataFrame:
    """``(column, mode, mode_count, n_distinct)`` of a value table; the smallest of tied values."""
    best = F.struct((-F.col("n")).alias("n"), F.col("value"), F.col("exact"))
    return values.groupBy("column").agg(F.min_by("value", best).alias("mode"), F.max("n").alias("mode_count"),
                                        F.count(F.lit(1)).alias("n_distinct"))


def median_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Column medians as driver values (one number per column); columns without values are absent."""
    return {c: v for (c, _), v in exact_quantiles(df, columns, [0.5]).items()} if columns else {}


def mode_columns(df: DataFrame, columns: Sequence[str], cast: str = "string") -> dict[str, object]:
    if not columns:
        return {}
    return {r["column"]: r["mode"] for r in most_frequent(value_table(df, columns, cast)).collect()}
