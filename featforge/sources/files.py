"""CSV and Parquet scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.operators.sampling import sample_n


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null everywhere in the library; NaN never leaves a reader."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, n_rows: int | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header. Pass ``schema`` on large files: inference costs one more scan."""
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if columns is not None:
        df = df.select(*columns)
    df = nan_to_null(df)
    return df if n_rows is None else df.limit(n_rows)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


@dataclass(frozen=True)
class TableSource:
    """Where a logical table lives and how to read it."""

    path: str
    format: str = "parquet"
    schema: T.StructType | str | None = None
    key: str | None = None


def load_table(spark: SparkSession, registry: Mapping[str, TableSource], name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    if name not in registry:
        raise KeyError(f"unknown table {name!r}; registered: {sorted(registry)}")
    source = registry[name]
    if source.format == "csv":
        return read_csv(spark, source.path, source.schema, columns=columns)
    if source.format == "parquet":
        return read_parquet(spark, source.path, columns)
    raise ValueError(f"unknown format {source.format!r} of table {name!r}")


def load_datasets(spark: SparkSession, registry: Mapping[str, TableSource], names: Sequence[str] | None = None,
                  sample: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """All registered tables as lazy frames; ``sample`` is the development mode that keeps n rows per table."""
    out = {}
    for name in names if names is not None else registry:
        df = load_table(spark, registry, name)
        if sample is not None:
            df = sample_n(df, sample, key=registry[name].key or df.columns, seed=seed)
        out[name] = df
    return out


_LOGICAL_TYPES = {
    "string": "Categorical", "boolean": "Boolean", "double": "Double", "float": "Double", "decimal": "Double",
    "tinyint": "Integer", "smallint": "Integer", "int": "Integer", "bigint": "Integer",
    "timestamp": "Datetime", "timestamp_ntz": "Datetime", "date": "Datetime",
}


def schema_report(df: DataFrame, key: str | None = None, foreign_keys: Sequence[str] = ()) -> DataFrame:
    """Column, physical type, logical type and tags, in column order."""
    rows = []
    for position, field in enumerate(df.schema.fields):
        physical = field.dataType.simpleString()
        logical = _LOGICAL_TYPES.get(physical.split("(")[0], "Unknown")
        if field.name == key:
            tags = "index"
        elif field.name in foreign_keys:
            tags = "foreign_key"
        elif logical in ("Integer", "Double"):
            tags = "numeric"
        else:
            tags = "category" if logical == "Categorical" else ""
        rows.append((position, field.name, physical, logical, tags))
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, physical_type string, logical_type string, tags string")


def write_predictions(df: DataFrame, path: str, key: str, probability: str = "probability",
                      target: str | None = None, mode: str = "errorifexists") -> None:
    """A submission ``(key, probability)``, or an out-of-fold table when ``target`` is given."""
    columns = [key] + ([target] if target else []) + [probability]
    write_csv(df.select(*columns), path, mode)
