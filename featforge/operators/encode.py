"""Encoding of string columns. Each operator learns categories in one job and returns a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.functions.numeric import as_column, col, literal, quote
from featforge.operators.ordered import OrderedTable, add_row_index
from featforge.operators.quantiles import unpivot
from featforge.operators.rows import string_columns
from featforge.session import cut_lineage

#: Categories of a column become columns or broadcast codes, so their number is checked for each column.
MAX_CATEGORIES = 10_000


def categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES, wide: str = "raise") -> dict[str, list[str]]:
    """Sorted distinct non-null values per column.

    A column with more than ``limit`` values raises, or is left out with ``wide="skip"``; nothing unbounded reaches the driver.
    """
    if not columns:
        return {}
    distinct = unpivot(df, columns, "string").where(F.col("value").isNotNull()).distinct()
    pairs = distinct.limit(limit * len(columns) + 1).collect()
    fit = list(columns)
    if len(pairs) > limit * len(columns):
        sizes = {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
        fit = [c for c in columns if sizes.get(c, 0) <= limit]
        pairs = distinct.where(F.col("column").isin(fit)).collect() if fit and wide == "skip" else []
    out: dict[str, list[str]] = {c: [] for c in fit}
    for r in pairs:
        out.setdefault(r["column"], []).append(r["value"])
    over = sorted({c for c in columns if c not in fit} | {c for c, v in out.items() if len(v) > limit})
    if over and wide == "raise":
        raise ValueError(f"more than {limit} categories in {over}; encode them with one_hot_vector, factorize or ordinal_encode")
    return {c: sorted(out[c]) for c in columns if c not in over}


@dataclass(frozen=True)
class OneHot:
    """Fitted categories; ``transform`` adds 0/1 columns ``<prefix>_<value>`` in place of the source columns.

    The prefix is the column name unless given; an empty prefix leaves the plain value as the name.
    """

    values: Mapping[str, Sequence[str]]
    null_category: bool = True
    prefixes: Mapping[str, str] | None = None
    drop_first: bool = False
    keep_source: bool = False

    def new_columns(self) -> dict[str, str]:
        """SQL text of each 0/1 column by name."""
        out: dict[str, str] = {}
        for c, values in self.values.items():
            prefix = (self.prefixes or {}).get(c, c)
            name = lambda v, prefix=prefix: f"{prefix}_{v}" if prefix else str(v)
            for v in list(values)[1 if self.drop_first else 0:]:
                out[name(v)] = f"cast({quote(c)} <=> {literal(v)} as int)"
            if self.null_category:
                out[name("nan")] = f"cast({quote(c)} is null as int)"
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if self.keep_source or c not in self.values]
        return df.selectExpr(*[quote(c) for c in kept], *self.texts())

    def texts(self) -> list[str]:
        return [f"{e} as {quote(n)}" for n, e in self.new_columns().items()]

    def add_to(self, df: DataFrame) -> DataFrame:
        """The 0/1 columns beside all columns of the table."""
        return df.selectExpr("*", *self.texts())


def fit_one_hot(df: DataFrame, cols: Sequence[str] | None = None, **options) -> OneHot:
    return OneHot(categories(df, string_columns(df) if cols is None else cols), **options)


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, null_category: bool = True,
            prefix: Mapping[str, str] | None = None, drop_first: bool = False,
            keep_source: bool = False) -> tuple[DataFrame, list[str]]:
    """One-hot all (or the given) string columns; returns the frame and the new column names."""
    model = fit_one_hot(df, cols, null_category=null_category, prefixes=prefix, drop_first=drop_first,
                        keep_source=keep_source)
    return model.transform(df), list(model.new_columns())


def category_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, slot)``: every distinct non-null value of each column, slots 0.. of a column in order of its values.

    A table of any size, numbered by the distributed row index; nothing of it reaches the driver.
    """
    distinct = unpivot(df, columns, "string").where(F.col("value").isNotNull()).distinct()
    numbered = OrderedTable(distinct, ["value"], by=["column"]).running(row_number="_row")
    return cut_lineage(numbered.select("column", "value", (F.col("_row") - 1).cast("int").alias("slot")))


def category_sizes(table: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Slots of each column of a category table."""
    found = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}
    return {c: found.get(c, 0) for c in columns}


def add_vectors(df: DataFrame, table: DataFrame, sizes: Mapping[str, int], names: Mapping[str, str]) -> DataFrame:
    """``df`` with a sparse 0/1 vector ``names[c]`` of ``sizes[c]`` slots for each column of ``names``.

    Values are looked up by a join with the category table; nulls, values it lacks and columns that ``df`` lacks give zeros.
    """
    codes = {c: f"_code_{i}" for i, c in enumerate(names)}
    out = df
    for c, code in codes.items():
        if c not in df.columns:
            out = out.withColumn(code, F.lit(-1.0))
            continue
        own = table.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("slot").alias("_slot"))
        out = out.join(own, col(c).cast("string") == F.col("_value"), "left").withColumn(
            code, F.coalesce(F.col("_slot"), F.lit(-1)).cast("double")).drop("_value", "_slot")
    # The model only needs the number of slots: a row with the last one tells it. One more slot takes what is unknown, and is dropped.
    last = df.sparkSession.createDataFrame([tuple(float(max(sizes[c], 1) - 1) for c in codes)], ", ".join(f"{v} double" for v in codes.values()))
    encoder = OneHotEncoder(inputCols=list(codes.values()), outputCols=[names[c] for c in codes], dropLast=True, handleInvalid="keep").fit(last)
    return encoder.transform(out).drop(*codes.values())


def one_hot_vector(df: DataFrame, columns: Sequence[str], table: DataFrame | None = None, name: str = "one_hot") -> tuple[DataFrame, DataFrame]:
    """``df`` with one sparse vector for all ``columns``, of any number of categories, and the category table that gives its slots.

    The slots of a column follow those of the columns before it.
    """
    table = category_table(df, columns) if table is None else table
    parts = {c: f"_hot_{i}" for i, c in enumerate(columns)}
    out = add_vectors(df, table, category_sizes(table, columns), parts)
    out = VectorAssembler(inputCols=list(parts.values()), outputCol=name).transform(out)
    return out.drop(*parts.values()), table


def _numbered(distinct: DataFrame, order: str) -> DataFrame:
    """``(value, code)`` with codes 0.. over a table of distinct values.

    Up to MAX_CATEGORIES values are listed in order, which stops early on larger tables; those are numbered with the
    distributed row index instead.
    """
    first = distinct.orderBy(order).limit(MAX_CATEGORIES + 1).select("value").collect()
    if len(first) > MAX_CATEGORIES:
        return add_row_index(distinct, [order], "_row").select("value", (F.col("_row") - 1).cast("int").alias("code"))
    schema = T.StructType([distinct.schema["value"], T.StructField("code", T.IntegerType())])
    return distinct.sparkSession.createDataFrame([(r["value"], i) for i, r in enumerate(first)], schema)


def factorize_map(df: DataFrame, column: str, order_by: Sequence[Column | str]) -> DataFrame:
    """``(value, code)``: codes by first appearance in the given order."""
    first = F.min(F.struct(*[as_column(o).alias(f"o{i}") for i, o in enumerate(order_by)])).alias("_first")
    distinct = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(first)
    return _numbered(distinct, "_first")


def ordinal_map(df: DataFrame, column: str, null_text: str = "Unknown") -> DataFrame:
    """``(value, code)``: codes in lexicographic order, nulls counted as ``null_text``."""
    distinct = df.select(F.coalesce(col(column), F.lit(null_text)).alias("value")).distinct()
    return _numbered(distinct, "value")


def apply_codes(df: DataFrame, column: str, codes: DataFrame, name: str | None = None,
                null_text: str | None = None) -> DataFrame:
    """Replace values by their code; unseen values and nulls are -1. Spark broadcasts the map while it is small."""
    name = name or column
    value = col(column) if null_text is None else F.coalesce(col(column), F.lit(null_text))
    keyed = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(keyed, value == F.col("_value"), "left")
    code = F.coalesce(F.col("_code"), F.lit(-1)).alias(name)
    if name in df.columns:
        return joined.select(*[code if c == name else quote(c) for c in df.columns])
    return joined.select(*[quote(c) for c in df.columns], code)


def factorize(df: DataFrame, column: str, order_by: Sequence[Column | str],
              name: str | None = None) -> tuple[DataFrame, DataFrame]:
    codes = factorize_map(df, column, order_by)
    return apply_codes(df, column, codes, name), codes


def ordinal_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return apply_codes(df, column, ordinal_map(df, column), name, null_text="Unknown")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values per column, counted after a shuffle by value."""
    if not columns:
        return {}
    rows = (unpivot(df, columns, "string").where(F.col("value").isNotNull()).distinct()
            .groupBy("column").count().collect())
    counts = {r["column"]: r["count"] for r in rows}
    return {c: counts.get(c, 0) for c in columns}


def auto_encode(df: DataFrame, max_one_hot: int = 10, exclude: Sequence[str] = ()) -> DataFrame:
    """Up to ``max_one_hot`` distinct values: one-hot; more: ordinal codes as double. Nulls are ``Unknown``."""
    text = [c for c in string_columns(df) if c not in set(exclude)]
    counts = distinct_counts(df, text)
    narrow = [c for c in text if counts[c] <= max_one_hot]
    for c in text:
        if c not in narrow:
            df = ordinal_encode(df, c)
            df = df.withColumn(c, col(c).cast("double"))
    filled = df.fillna("Unknown", subset=narrow) if narrow else df
    return one_hot(filled, narrow, null_category=False)[0]


def rollup_encoded(scores: DataFrame, mapping: Mapping[str, str], feature: str = "feature",
                   values: Sequence[str] = ("importance",)) -> DataFrame:
    """Sum the scores of encoded columns back onto their source column; unmapped names stay."""
    source = F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    if pairs:
        source = F.element_at(F.create_map(*pairs), col(feature))
    return (scores.groupBy(F.coalesce(source, col(feature)).alias(feature))
            .agg(*[F.sum(col(v)).alias(v) for v in values]))
