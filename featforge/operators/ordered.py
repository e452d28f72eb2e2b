"""Running values over an ordered table without putting a key, or the whole table, into one task.

The rows are range-partitioned by (key, order), so a hot key is spread over as many partitions as its rows need.
Each partition computes its own running values; what must be added from earlier partitions is known from one
summary row per (partition, key), and only for keys that cross a partition boundary. Those are at most two rows
per partition, which is the size bound of the one broadcast used here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featforge.functions.numeric import as_column, col, literal
from featforge.operators.quantiles import unpivot
from featforge.session import cut_lineage

_PART = "_part"


class OrderedTable:
    """A table fixed in (by, order) order. ``order`` must be a total order within a key, else ties are arbitrary."""

    def __init__(self, df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = ()):
        self.by = list(by)
        names, exprs = [], {}
        for i, o in enumerate(order):
            if isinstance(o, str):
                names.append(o)
            else:
                names.append(f"_order_{i}")
                exprs[f"_order_{i}"] = o
        self.order = names
        self._helpers = list(exprs)
        if exprs:
            df = df.withColumns(exprs)
        ranged = df.repartitionByRange(*[col(c) for c in self.by + names])
        # The partition number is stored with the rows: every pass below reads the same assignment.
        self.rows = cut_lineage(ranged.withColumn(_PART, F.spark_partition_id()))

    def running(self, sums: Mapping[str, Column | str] | None = None, lags: Mapping[str, Column | str] | None = None,
                row_number: str | None = None) -> DataFrame:
        """Add running sums (nulls count as 0), previous values and 1-based row numbers, per key."""
        return self._running(self.rows, sums or {}, lags or {}, row_number).drop(_PART, *self._helpers)

    def advance(self, **kwargs) -> OrderedTable:
        """The same ordered table with the running columns added: a second scan needs no second sort by range."""
        out = object.__new__(OrderedTable)
        out.by, out.order, out._helpers = self.by, self.order, self._helpers
        out.rows = self._running(self.rows, kwargs.get("sums") or {}, kwargs.get("lags") or {},
                                 kwargs.get("row_number"))
        return out

    def with_columns(self, exprs: Mapping[str, Column]) -> OrderedTable:
        out = object.__new__(OrderedTable)
        out.by, out.order, out._helpers = self.by, self.order, self._helpers
        out.rows = self.rows.withColumns(dict(exprs))
        return out

    def _running(self, rows: DataFrame, sums: Mapping, lags: Mapping, row_number: str | None) -> DataFrame:
        keys = [col(c) for c in self.by]
        local = Window.partitionBy(_PART, *keys).orderBy(*[col(o) for o in self.order])
        upto = local.rowsBetween(Window.unboundedPreceding, 0)
        added, pieces = {"_n": F.row_number().over(local)}, [F.count(F.lit(1)).alias("_rows")]
        last_row = F.struct(*[col(o) for o in self.order])
        for name, c in sums.items():
            filled = F.coalesce(as_column(c), F.lit(0))
            added[f"_s_{name}"] = F.sum(filled).over(upto)
            pieces.append(F.sum(filled).alias(f"_t_{name}"))
        for name, c in lags.items():
            added[f"_l_{name}"] = F.lag(as_column(c)).over(local)
            pieces.append(F.max_by(as_column(c), last_row).alias(f"_v_{name}"))

        per_piece = rows.groupBy(_PART, *keys).agg(*pieces)
        in_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        before = in_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_c__n")]
        for name in sums:
            carried.append(F.sum(col(f"_t_{name}")).over(before).alias(f"_c_{name}"))
        for name in lags:
            carried.append(F.lag(col(f"_v_{name}")).over(in_key.orderBy(_PART)).alias(f"_p_{name}"))
        offsets = (per_piece.withColumn("_pieces", F.count(F.lit(1)).over(in_key)).where("_pieces > 1")
                   .select(F.col(_PART).alias("_o_part"), *[k.alias(f"_o_{c}") for k, c in zip(keys, self.by)],
                           *carried))

        scanned = rows.withColumns(added)
        match = F.col(_PART) == F.col("_o_part")
        for c in self.by:
            match = match & col(c).eqNullSafe(col(f"_o_{c}"))
        joined = scanned.join(F.broadcast(offsets), match, "left")
        out = [col(c) for c in rows.columns]
        for name in sums:
            carry = col(f"_c_{name}")
            out.append(F.when(carry.isNull(), col(f"_s_{name}")).otherwise(col(f"_s_{name}") + carry).alias(name))
        for name in lags:
            out.append(F.when(F.col("_n") == 1, col(f"_p_{name}")).otherwise(col(f"_l_{name}")).alias(name))
        if row_number:
            out.append((F.col("_n") + F.coalesce(F.col("_c__n"), F.lit(0))).cast("long").alias(row_number))
        return joined.select(*out)


def add_row_index(df: DataFrame, order_by: Sequence[Column | str], name: str = "index") -> DataFrame:
    """Row numbers 1..n in the given order."""
    return OrderedTable(df, order_by).running(row_number=name)


def diff(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """``DIFF(c)``: value minus the previous row's value; null when either is missing."""
    lagged = OrderedTable(df, order, by).running(lags={f"_prev_{c}": c for c in columns})
    return lagged.select(*[col(c) for c in df.columns],
                         *[(col(c) - col(f"_prev_{c}")).alias(f"DIFF({c})") for c in columns])


def cumulative(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], by: Sequence[str] = (),
               functions: Sequence[str] = ("DIFF", "CUM_SUM", "CUM_MEAN")) -> DataFrame:
    """``DIFF``, ``CUM_SUM`` and ``CUM_MEAN`` of several columns in one scan; null rows are skipped and stay null."""
    sums, lags = {}, {}
    for c in columns:
        if {"CUM_SUM", "CUM_MEAN"} & set(functions):
            sums[f"_sum_{c}"] = c
        if "CUM_MEAN" in functions:
            sums[f"_cnt_{c}"] = col(c).isNotNull().cast("long")
        if "DIFF" in functions:
            lags[f"_prev_{c}"] = c
    run = OrderedTable(df, order, by).running(sums=sums, lags=lags)
    out = [col(c) for c in df.columns]
    for c in columns:
        for fn in functions:
            if fn == "DIFF":
                e = col(c) - col(f"_prev_{c}")
            elif fn == "CUM_SUM":
                e = F.when(col(c).isNotNull(), col(f"_sum_{c}"))
            elif fn == "CUM_MEAN":
                e = F.when(col(c).isNotNull(), col(f"_sum_{c}").cast("double") / col(f"_cnt_{c}"))
            else:
                raise ValueError(f"unknown transform {fn!r}")
            out.append(e.alias(f"{fn}({c})"))
    return run.select(*out)


def cum_sum(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    return cumulative(df, columns, order, by, ("CUM_SUM",))


def cum_mean(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    return cumulative(df, columns, order, by, ("CUM_MEAN",))


def percentile_rank(df: DataFrame, column: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """``PERCENTILE(c)``: average rank among ties over the number of non-null values.

    Ranks are computed on the distinct values with their counts, so a value held by most rows is one row.
    """
    name = name or f"PERCENTILE({column})"
    keys = [*by, column]
    distinct = df.where(col(column).isNotNull()).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_ties"))
    run = OrderedTable(distinct, [column], by).running(sums={"_upto": "_ties"})
    if by:
        total = distinct.groupBy(*[col(k) for k in by]).agg(F.sum("_ties").alias("_total"))
        condition = F.lit(True)
        for k in by:
            condition = condition & run[k].eqNullSafe(total[k])
        run = run.join(total, condition).select(*[run[c] for c in run.columns], "_total")
    else:
        run = run.withColumn("_total", F.lit(run.agg(F.max("_upto")).first()[0]))
    ranks = run.select(*[col(k).alias(f"_r_{k}") for k in keys],
                       ((F.col("_upto") - (F.col("_ties") - 1) / 2.0) / F.col("_total")).alias(name))
    condition = col(column) == col(f"_r_{column}")
    for k in by:
        condition = condition & col(k).eqNullSafe(col(f"_r_{k}"))
    return df.join(ranks, condition, "left").select(*[col(c) for c in df.columns], col(name))


def percentile_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``PERCENTILE(c)`` of several columns at once, as ``percentile_rank`` gives for each; values are compared as doubles.

    All columns share one long table (column, value): one count of its values, one ordered scan by column, one join and one
    pivot by row, whatever the number of columns. The wide table is written once, so that its rows keep their numbers.
    """
    if not columns:
        return df
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    long = unpivot(rows, columns, keep=["_row"]).where(F.col("value").isNotNull())
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_ties"))
    run = OrderedTable(counted, ["value"], ["column"]).running(sums={"_upto": "_ties"})
    totals = counted.groupBy("column").agg(F.sum("_ties").alias("_total"))
    ranks = run.join(totals, "column").selectExpr("column", "value", "(_upto - (_ties - 1) / 2.0D) / _total as _rank")
    ranked = long.join(ranks, ["column", "value"]).groupBy("_row")
    names = [f"PERCENTILE({c})" for c in columns]
    wide = ranked.agg(*[F.expr(f"max(case when column = {literal(c)} then _rank end)").alias(n) for c, n in zip(columns, names)])
    return rows.join(wide, "_row", "left").select(*[col(c) for c in df.columns], *[col(n) for n in names])


def longest_repetition(df: DataFrame, key: str, order: Sequence[Column | str], column: str,
                       name: str = "longest_repetition") -> DataFrame:
    """Per key, the value of the longest run of equal consecutive non-null values; the first run wins a tie."""
    present = df.where(col(column).isNotNull())
    table = OrderedTable(present, order, by=[key]).advance(lags={"_prev": column}, row_number="_rn")
    table = table.with_columns({"_starts": F.when(col("_prev").eqNullSafe(col(column)), 0).otherwise(1)})
    runs = (table.running(sums={"_run": "_starts"})
            .groupBy(col(key), F.col("_run")).agg(F.first(col(column)).alias("_value"),
                                                  F.count(F.lit(1)).alias("_length")))
    best = runs.groupBy(col(key)).agg(F.max_by("_value", F.struct("_length", -F.col("_run"))).alias(name))
    return df.select(col(key)).distinct().join(best, key, "left")
