"""Grouped aggregates and user-defined aggregates."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.functions import aggregates as X
from featforge.operators import rollup as A
from featforge.operators.encode import fit_one_hot
from featforge.operators.joins import attach
from featforge.operators.ordered import longest_repetition as longest_run
from featforge.operators.rows import null_sentinel
from featforge.plans.keys import key, rounded, table

_SQL_FN = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "sum": "coalesce(sum({c}), 0)",
           "var": "var_samp({c})", "std": "stddev_samp({c})", "count": "count({c})::bigint", "size": "count(*)::bigint",
           "nunique": "count(distinct {c})::bigint"}


def _sql(column, fns, prefix="", digits=4, name="{p}{c}_{f}", upper=True):
    out = []
    for fn in fns:
        e = _SQL_FN[fn].format(c=column)
        if "bigint" not in e:
            e = f"round({e}, {digits})"
        out.append(f'{e} as "{name.format(p=prefix, c=column, f=fn.upper() if upper else fn)}"')
    return ", ".join(out)


@key("group_agg", f"""
select l_orderkey, {_sql("l_quantity", ["min", "max", "mean", "sum", "var"], "L_")},
       {_sql("l_partkey", ["nunique", "size"], "L_")}
from (select l_orderkey, nullif(l_quantity, 50) as l_quantity, l_partkey from lineitem) group by 1""")
def group_agg(spark, sf_dir):
    df = null_sentinel(table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_partkey"), ["l_quantity"], 50.0)
    return rounded(A.group_agg(df, "l_orderkey", {"l_quantity": ["min", "max", "mean", "sum", "var"],
                                                  "l_partkey": ["nunique", "size"]}, "L_"), 4)


_ALL = ["min", "max", "mean", "sum", "var"]


@key("group_agg_all", "select l_suppkey, " + ", ".join(
    _sql(c, _ALL, "CC_") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " from lineitem group by 1")
def group_agg_all(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(A.group_agg_all(df, "l_suppkey", _ALL, "CC_"), 4)


@key("group_agg_where", """
select t.*, a.* exclude (l_suppkey), r.* exclude (l_suppkey)
from (select l_suppkey, round(sum(l_extendedprice), 2) as "T_l_extendedprice_SUM", count(*)::bigint as "T_l_extendedprice_SIZE"
      from lineitem group by 1) t
left join (select l_suppkey, round(sum(l_extendedprice), 2) as "A_l_extendedprice_SUM", count(*)::bigint as "A_l_extendedprice_SIZE",
                  round(avg(l_discount), 6) as "A_l_discount_MEAN"
           from lineitem where l_returnflag = 'A' group by 1) a using (l_suppkey)
left join (select l_suppkey, round(sum(l_extendedprice), 2) as "R_l_extendedprice_SUM", count(*)::bigint as "R_l_extendedprice_SIZE",
                  round(avg(l_discount), 6) as "R_l_discount_MEAN"
           from lineitem where l_returnflag = 'R' and l_quantity > 49 group by 1) r using (l_suppkey)""")
def group_agg_where(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity")
    out = A.group_agg_where(df, "l_suppkey", {"l_extendedprice": ["sum", "size"], "l_discount": ["mean"]},
                            {"A_": F.col("l_returnflag") == "A",
                             "R_": (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)},
                            "T_", total={"l_extendedprice": ["sum", "size"]})
    sums = [c for c in out.columns if c.endswith("_SUM")]
    return rounded(out.withColumns({c: F.round(c, 2) for c in sums}))


@key("category_share", "select o_custkey, " + ", ".join(
    f"round(avg((o_orderstatus is not distinct from '{s}')::int), 6) as \"o_orderstatus_{s}_MEAN\"" for s in "FOP")
    + ", round(avg((o_orderstatus is null)::int), 6) as \"o_orderstatus_nan_MEAN\" from orders group by 1")
def category_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    return rounded(A.category_share(orders, "o_custkey", fit_one_hot(orders)))


@key("group_mean_numeric", """
select l_orderkey, count(l_partkey)::double as "avg_l_partkey", round(avg(l_quantity), 6) as "avg_l_quantity",
       round(avg(l_extendedprice), 6) as "avg_l_extendedprice", round(avg(l_linenumber), 6) as "avg_l_linenumber"
from lineitem group by 1""")
def group_mean_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag")
    return rounded(A.group_mean_numeric(df, "l_orderkey", ["l_partkey"], "avg_"))


@key("two_stage_rollup", """
with o as (select o_orderkey, o_custkey, o_totalprice, m.* exclude (l_orderkey) from orders left join
           (select l_orderkey, min(l_quantity) as qty_min, max(l_quantity) as qty_max, count(*) as qty_size
            from lineitem group by 1) m on o_orderkey = l_orderkey)
select o_custkey, round(avg(o_totalprice), 6) as "B_o_totalprice_MEAN", min(qty_min) as "B_l_quantity_MIN_MIN",
       max(qty_max) as "B_l_quantity_MAX_MAX", round(avg(qty_size), 6) as "B_l_quantity_SIZE_MEAN",
       coalesce(sum(qty_size), 0)::bigint as "B_l_quantity_SIZE_SUM"
from o group by 1""")
def two_stage_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    out = A.two_stage_rollup(orders, lines, "o_orderkey", "o_custkey", {"l_quantity": ["min", "max", "size"]},
                             {"o_totalprice": ["mean"], "l_quantity_MIN": ["min"], "l_quantity_MAX": ["max"],
                              "l_quantity_SIZE": ["mean", "sum"]}, "B_")
    return rounded(out)


_LINES_SQL = "(select l.*, o_custkey from lineitem l join orders on l_orderkey = o_orderkey)"


def _lines(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem", "l_orderkey", *columns).join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@key("mean_of_means", f"""
select o_custkey, round(avg(m), 9) as mean_of_means
from (select o_custkey, l_orderkey, avg(l_discount - l_tax) as m from {_LINES_SQL} where l_quantity > 10 group by 1, 2) group by 1""")
def mean_of_means(spark, sf_dir):
    lines = _lines(spark, sf_dir, "l_discount", "l_tax", "l_quantity").where("l_quantity > 10")
    return rounded(A.mean_of_means(lines, "o_custkey", "l_orderkey", F.col("l_discount") - F.col("l_tax")), 9)


@key("ratio_of_sums", """
select l_orderkey, round(sum(l_discount) / nullif(sum(l_tax), 0), 6) as ratio from lineitem group by 1""")
def ratio_of_sums(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_discount", "l_tax")
    # Sums of hundredths: rounded before dividing so that an all-zero sum is exactly zero.
    return rounded(A.agg_columns(df, "l_orderkey", ratio=X.ratio_of_sums("l_discount", "l_tax")))


@key("last_by", """
select user_id, arg_max(event_type, ts) filter (event_type is not null) as last_type,
       arg_max(value, ts) filter (value is not null) as last_value
from (select user_id, ts, nullif(event_type, 'view') as event_type, case when event_type <> 'error' then value end as value from events)
group by 1""")
def last_by(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "user_id", "ts", F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return A.agg_columns(df, "user_id", last_type=X.last_by("event_type", "ts"), last_value=X.last_by("value", "ts"))


@key("agg_where", """
select o_custkey, max(o_totalprice) filter (o_orderstatus = 'F') as max_closed,
       round(avg(o_totalprice) filter (o_orderstatus = 'F'), 6) as mean_closed,
       count(*) filter (o_orderstatus = 'F')::bigint as n_closed
from orders group by 1""")
def agg_where(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    return rounded(A.agg_where(df, "o_custkey", F.col("o_orderstatus") == "F", {
        "max_closed": ("o_totalprice", "max"), "mean_closed": ("o_totalprice", "mean"), "n_closed": ("o_totalprice", "size")}))


@key("share_true", """
select l_orderkey, round(avg(coalesce(nullif(l_linenumber, 7) > l_quantity, false)::int), 6) as share from lineitem group by 1""")
def share_true(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return rounded(A.agg_columns(df, "l_orderkey", share=X.share_true(F.nullif("l_linenumber", F.lit(7)) > F.col("l_quantity"))))


@key("count_ratio", """
select o_custkey, nullif(count(*) filter (o_orderstatus = 'P'), 0) / count(*)::double as ratio from orders group by 1""")
def count_ratio(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    return A.agg_columns(df, "o_custkey", ratio=X.count_ratio(F.col("o_orderstatus") == "P"))


@key("mean_ratio", """
select l_orderkey, round(avg(l_discount / nullif(l_tax, 0)), 6) as ratio from lineitem group by 1""")
def mean_ratio(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_discount", "l_tax")
    return rounded(A.agg_columns(df, "l_orderkey", ratio=X.mean_ratio("l_discount", "l_tax")))


@key("groupby_agg_simple", f"""
select l_returnflag, l_linestatus, {_sql("l_quantity", ["sum", "mean", "count", "min", "max", "std"], digits=3, name="{c}_{f}", upper=False)},
       {_sql("l_extendedprice", ["sum"], digits=1, name="{c}_{f}", upper=False)}
from lineitem group by 1, 2""")
def groupby_agg_simple(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    out = A.groupby_agg(df, ["l_returnflag", "l_linestatus"],
                        {"l_quantity": ["sum", "mean", "count", "min", "max", "std"], "l_extendedprice": "sum"})
    return rounded(out.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 1)), 3)


_STAT_COLUMNS = ("l_quantity", "l_discount", "l_extendedprice", "l_linenumber")


@key("column_stats", " union all ".join(f"""
select '{c}' as "column", count({c})::bigint as "count", count_if({c} is null)::bigint as missing, min({c})::double as "min",
       max({c})::double as "max", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(var_samp({c}), 3) as var,
       (select v::double from (select {c} as v, count(*) as n from lineitem where {c} is not null group by 1 order by n desc, v limit 1)) as mode,
       count(distinct {c})::bigint as nunique, round(median({c}::double), 6) as median
from lineitem""" for c in _STAT_COLUMNS))
def column_stats(spark, sf_dir):
    out = A.column_stats(table(spark, sf_dir, "lineitem", *_STAT_COLUMNS))
    return rounded(out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "var": F.round("var", 3)}))


@key("value_counts", "select p_type, count(*)::bigint as \"count\" from part group by 1")
def value_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "part", "p_type"), "p_type")


@key("importance_mean", """
select p_brand as feature, round(avg(gain), 6) as importance
from (select p_brand, l_linenumber as fold, sum(l_discount) as gain from lineitem join part on l_partkey = p_partkey group by 1, 2)
group by 1""")
def importance_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_discount")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    per_fold = attach(lines, brands, "l_partkey").where("feature is not null").groupBy("feature", "l_linenumber").agg(
        F.sum("l_discount").alias("importance"))
    return rounded(A.mean_by(per_fold, "feature", "importance"))


@key("normalized_mode_count", """
with c as (select user_id, v, count(*) as n from (select user_id, nullif(event_type, 'view') as v from events) group by 1, 2)
select user_id, max(n) filter (v is not null) / sum(n)::double as normalized_mode_count from c group by 1""")
def normalized_mode_count(spark, sf_dir):
    df = null_sentinel(table(spark, sf_dir, "events", "user_id", "event_type"), ["event_type"], "view")
    return A.normalized_mode_count(df, "user_id", "event_type")


@key("longest_repetition", """
with e as (select user_id, event_type, ts, row_number() over (partition by user_id order by ts)
                  - row_number() over (partition by user_id, event_type order by ts) as island
           from events where event_type <> 'view'),
runs as (select user_id, event_type, island, count(*) as n, min(ts) as started from e group by 1, 2, 3),
best as (select user_id, event_type, row_number() over (partition by user_id order by n desc, started) as r from runs)
select u.user_id, b.event_type as longest_repetition
from (select distinct user_id from events) u left join best b on u.user_id = b.user_id and b.r = 1""")
def longest_repetition(spark, sf_dir):
    df = null_sentinel(table(spark, sf_dir, "events", "user_id", "event_type", "ts"), ["event_type"], "view")
    return longest_run(df, "user_id", ["ts"], "event_type")


@key("group_mode", """
select user_id, (array_agg(event_type order by n desc, event_type))[1] as mode
from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def group_mode(spark, sf_dir):
    return A.group_mode(table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type")


@key("group_trend", """
select user_id, round(case when min(x) < max(x) then regr_slope(value, x) end, 4) as trend
from (select user_id, value, epoch_us(ts) / 86400000000.0::double as x from events) group by 1""")
def group_trend(spark, sf_dir):
    return rounded(A.agg_columns(table(spark, sf_dir, "events", "user_id", "value", "ts"), "user_id",
                                 trend=X.trend("value", F.col("ts").cast("timestamp"))), 4)


@key("percent_true", """
select user_id, round(avg((event_type = 'purchase')::int), 6) as bought from events group by 1""")
def percent_true(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").alias("bought"))
    return rounded(A.agg_columns(df, "user_id", bought=X.percent_true("bought")))


@key("custom_primitive", """
select l_orderkey, max(l_quantity) - min(l_quantity) as "RANGE(l_quantity)",
       max(l_extendedprice) - min(l_extendedprice) as "RANGE(l_extendedprice)"
from lineitem group by 1""")
def custom_primitive(spark, sf_dir):
    registry = A.PrimitiveRegistry()
    registry.register("range", [T.DoubleType], T.DoubleType(), lambda c: F.max(c) - F.min(c))
    return registry.apply(table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice"), "l_orderkey", "range")


def _add_values(state, values):
    """Counts of values, nulls among them."""
    for v in values:
        state[v] = state.get(v, 0) + 1
    return state


def _add_counts(state, other):
    for v, n in other.items():
        state[v] = state.get(v, 0) + n
    return state


def _mode_share(state):
    known = [n for v, n in state.items() if v is not None]
    return max(known) / sum(state.values()) if known else None


def _mode_state(registry):
    registry.register_state("mode_share", [T.StringType], T.DoubleType(), dict, _add_values, _add_counts, _mode_share)
    return registry


@key("state_primitive", """
with c as (select o_custkey, o_orderpriority as v, count(*) as n from orders group by 1, 2),
s as (select o_custkey, o_orderstatus as v, count(*) as n from orders group by 1, 2)
select o_custkey, round(p, 9) as "MODE_SHARE(o_orderpriority)", round(q, 9) as "MODE_SHARE(o_orderstatus)"
from (select o_custkey, max(n)::double / sum(n)::double as p from c group by 1) join (select o_custkey, max(n)::double / sum(n)::double as q from s group by 1)
     using (o_custkey)""")
def state_primitive(spark, sf_dir):
    """A primitive over raw values, as a state folded by tasks and merged."""
    df = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    return rounded(_mode_state(A.PrimitiveRegistry()).apply(df, "o_custkey", "mode_share"), 9)


@key("state_primitive_hot", """
select l_returnflag, round(max(n)::double / sum(n)::double, 9) as "MODE_SHARE(l_shipdate)"
from (select l_returnflag, l_shipdate, count(*) as n from lineitem group by 1, 2) group by 1""")
def state_primitive_hot(spark, sf_dir):
    """The same with three keys that hold all rows between them."""
    df = table(spark, sf_dir, "lineitem", "l_returnflag", "l_shipdate").select("l_returnflag", F.col("l_shipdate").cast("string").alias("l_shipdate"))
    return rounded(_mode_state(A.PrimitiveRegistry()).apply(df, "l_returnflag", "mode_share"), 9)


@key("dfs_state_primitive", """
with c as (select o_custkey, o_orderpriority as v, count(*) as n from orders group by 1, 2),
s as (select o_custkey, o_orderstatus as v, count(*) as n from orders group by 1, 2)
select c_custkey, (select count(*) from orders where o_custkey = c_custkey)::bigint as "COUNT(orders)",
       round(q, 9) as "NORMALIZED_MODE_COUNT(orders.o_orderstatus)", round(p, 9) as "NORMALIZED_MODE_COUNT(orders.o_orderpriority)",
       round(q, 9) as "MODE_SHARE(orders.o_orderstatus)", round(p, 9) as "MODE_SHARE(orders.o_orderpriority)"
from customer left join (select o_custkey, max(n)::double / sum(n)::double as p from c group by 1) a on a.o_custkey = c_custkey
     left join (select o_custkey, max(n)::double / sum(n)::double as q from s group by 1) b on b.o_custkey = c_custkey""")
def dfs_state_primitive(spark, sf_dir):
    """A built-in primitive of text columns beside the same one written as a state, both found by synthesis."""
    from featforge.operators import synthesis as D
    es = D.EntitySet("customer")
    es.add("customer", table(spark, sf_dir, "customer", "c_custkey"), "c_custkey")
    es.add("orders", table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    es.relate("customer", "c_custkey", "orders", "o_custkey")
    registry = _mode_state(A.PrimitiveRegistry())
    return rounded(D.dfs(es, ["count", "normalized_mode_count", "mode_share"], max_depth=1, custom=registry.primitives()), 9)
