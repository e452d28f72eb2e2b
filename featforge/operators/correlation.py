"""Pairwise correlation of many columns in one scan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.functions.numeric import col
from featforge.operators.profile import corr_with
from featforge.operators.rollup import per_column
from featforge.operators.rows import split_columns

_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
#: Columns of a tile: up to as many, one pass over the rows does; more take a task for each partition and tile.
TILE = 256


def _moments(low: int, high: int):
    """Co-moment sums of one partition for the pairs of the columns of a tile with all later columns; nulls drop out pair by pair."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for batch in batches:
            raw = batch.to_numpy(dtype=float)[:, low:]  # earlier columns have met this tile in theirs
            mask = (~np.isnan(raw)).astype(float)
            x = np.where(mask > 0, raw, 0.0)
            t, m = x[:, :high - low], mask[:, :high - low]
            part = [m.T @ mask, t.T @ mask, m.T @ x, (t * t).T @ mask, m.T @ (x * x), t.T @ x]
            sums = part if sums is None else [np.add(a, b, out=a) for a, b in zip(sums, part)]
        if sums is None:
            return
        i, j = np.nonzero(np.arange(sums[0].shape[1])[None, :] > np.arange(high - low)[:, None])
        yield pd.DataFrame({"tile": [low], "i": [(i + low).astype(np.int32)], "j": [(j + low).astype(np.int32)],
                            **{s: [v[i, j]] for s, v in zip(_SUMS, sums)}})

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of many partitions as one row for each tile."""
    total: dict[int, list] = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            tile, values = int(row[0]), [np.asarray(v) for v in row[1:]]
            old = total.get(tile)
            total[tile] = values if old is None else old[:2] + [a + b for a, b in zip(old[2:], values[2:])]
    for tile, values in total.items():
        yield pd.DataFrame({"tile": [tile], **{c: [v] for c, v in zip(["i", "j", *_SUMS], values)}})


def corr_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, corr)`` for every pair of columns, a before b; pairwise complete, null when a side is constant.

    Columns are standardised first, so the sums keep their digits. Cost per row is p*p multiply-adds in numpy. Columns are dealt
    in tiles of ``TILE``: a task adds up the sums of one tile with all later columns, so its memory grows with p, not with its square, and
    the sums of a tile are merged in about as many tasks as the square root of their number before they are spread by pair.
    """
    columns = split_columns(df)[0] if columns is None else list(columns)
    scale = df.agg(*[e for c in columns for e in (F.avg(col(c).cast("double")), F.stddev_pop(col(c).cast("double")))]).first()
    scaled = []
    for i, c in enumerate(columns):
        mean, std = scale[2 * i], scale[2 * i + 1]
        scaled.append(((col(c).cast("double") - (mean or 0.0)) / (std if std else 1.0)).alias(f"x{i}"))
    kind = "tile int, i array<int>, j array<int>, " + ", ".join(f"{s} array<double>" for s in _SUMS)
    narrow = df.select(*scaled)
    groups = math.ceil(math.sqrt(max(1, narrow.rdd.getNumPartitions())))
    tiles = [narrow.mapInPandas(_moments(low, min(low + TILE, len(columns))), kind) for low in range(0, len(columns), TILE)]
    sums = reduce(DataFrame.union, tiles)
    spread = F.pmod(F.spark_partition_id(), F.lit(groups))  # of one tile, so that a task merges few tiles
    merged = sums.withColumn("_share", spread).repartition(groups * len(tiles), "tile", "_share").drop("_share").mapInPandas(_merged, kind)
    pairs = merged.select(F.explode(F.arrays_zip("i", "j", *_SUMS)).alias("_p")).select("_p.*")
    sums = pairs.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    varied = (vx > 1e-12 * F.col("n") * F.col("n")) & (vy > 1e-12 * F.col("n") * F.col("n"))
    corr = F.when(varied, F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select("i", "j", F.element_at(names, F.col("i") + 1).alias("a"),
                       F.element_at(names, F.col("j") + 1).alias("b"), corr.alias("corr"))


def corr_matrix(df: DataFrame, k: int | None = None, target: str | None = None,
                columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix ``(a, b, corr)`` of all columns, of the k with the highest variance, or of the k most correlated
    with the target."""
    columns = split_columns(df, exclude=[target] if target else [])[0] if columns is None else list(columns)
    if k is not None:
        if target is None:
            scores = per_column(df, columns, {"s": lambda c: f"var_samp(cast({c} as double))"})
        else:
            scores = corr_with(df, target, columns).select("column", F.abs("corr").alias("s"))
        best = {r["column"] for r in scores.orderBy(F.desc_nulls_last("s"), "column").limit(k).collect()}
        columns = [c for c in columns if c in best]
    pairs = corr_pairs(df, columns).select("a", "b", "corr")
    mirrored = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    diagonal = per_column(df, columns, {"v": lambda c: f"stddev_pop(cast({c} as double))"}).select(
        F.col("column").alias("a"), F.col("column").alias("b"), F.when(F.col("v") > 0, 1.0).alias("corr"))
    return pairs.unionByName(mirrored).unionByName(diagonal)


def high_corr_pairs(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, corr)`` of the pairs whose absolute correlation is above the threshold."""
    return corr_pairs(df, columns).where(F.abs("corr") > threshold).select("a", "b", "corr")


def correlated_columns(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None) -> list[str]:
    """The later column of each highly correlated pair, in column order."""
    found = {r["b"] for r in high_corr_pairs(df, threshold, columns).select("b").distinct().collect()}
    return [c for c in df.columns if c in found]


def drop_correlated(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None) -> DataFrame:
    gone = set(correlated_columns(df, threshold, columns))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def leakage_columns(df: DataFrame, target: str, threshold: float = 0.9) -> DataFrame:
    """Columns that all but repeat the target."""
    return corr_with(df, target).where(F.abs("corr") > threshold)


