"""Deep feature synthesis over customer <- orders <- lineitem."""

from pyspark.sql import functions as F

from featforge.operators import synthesis as D
from featforge.plans.keys import NUDGE, key, rounded, table

_ORDER_NUMBERS = ("o_totalprice",)
_LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
_FN = {"SUM": "coalesce(sum({c}), 0)", "MEAN": "avg({c})", "MAX": "max({c})", "MIN": "min({c})", "STD": "stddev_samp({c})"}
_STD_DIGITS, _DIGITS = 3, 5


def entity_set(spark, sf_dir, with_lines=True):
    es = D.EntitySet("customer")
    es.add("customer", table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), "c_custkey", exclude=["c_acctbal"])
    es.add("orders", table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", *_ORDER_NUMBERS), "o_orderkey")
    es.relate("customer", "c_custkey", "orders", "o_custkey")
    if with_lines:
        lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", *_LINE_NUMBERS)
        es.add("lineitem", lines, "l_partkey")
        es.relate("orders", "o_orderkey", "lineitem", "l_orderkey")
    return es


def _columns(child, numbers, quote=True):
    """``"FN(child.c)" := aggregate`` pairs in SQL."""
    out = []
    for fn, sql in _FN.items():
        for c in numbers:
            out.append((f"{fn}({child}.{c})", sql.format(c=f'"{c}"' if quote else c)))
    return out


_LINE_FEATURES = _columns("lineitem", _LINE_NUMBERS)
_STACKED = ["COUNT(lineitem)"] + [n for n, _ in _LINE_FEATURES]
_ORDER_FEATURES = _columns("orders", [*_ORDER_NUMBERS, *_STACKED])
_CHILD = ("select l_orderkey, count(*) as \"COUNT(lineitem)\", " + ", ".join(f'{e} as "{n}"' for n, e in _LINE_FEATURES)
          + " from lineitem group by 1")
_ORDERS = ("select o_custkey, o_totalprice, coalesce(\"COUNT(lineitem)\", 0) as \"COUNT(lineitem)\", "
           + ", ".join(f'm."{n}"' for n, _ in _LINE_FEATURES)
           + f" from orders left join ({_CHILD}) m on o_orderkey = l_orderkey")


def _digits(name):
    return _STD_DIGITS if "STD" in name else 2 if "extendedprice" in name or "totalprice" in name else _DIGITS


def _typed(name, expression):
    integral = name in ("SUM(orders.COUNT(lineitem))", "MAX(orders.COUNT(lineitem))", "MIN(orders.COUNT(lineitem))")
    return f'({expression})::bigint as "{name}"' if integral else f'round({expression} * {NUDGE}, {_digits(name)}) as "{name}"'


_DEPTH2 = ("select o_custkey, count(*) as \"COUNT(orders)\", " + ", ".join(_typed(n, e) for n, e in _ORDER_FEATURES)
           + f" from ({_ORDERS}) group by 1")


def _checked(df):
    """Round per feature: sums of prices have large values and standard deviations lose more digits."""
    return rounded(df, {c: _digits(c) for c in df.columns if c != "c_acctbal"}, nudge=True)


@key("dfs_depth1", "select c_custkey, c_acctbal, coalesce(\"COUNT(orders)\", 0)::bigint as \"COUNT(orders)\", "
     + ", ".join(f'"{n}"' for n, _ in _columns("orders", _ORDER_NUMBERS))
     + " from customer left join (select o_custkey, count(*) as \"COUNT(orders)\", "
     + ", ".join(_typed(n, e) for n, e in _columns("orders", _ORDER_NUMBERS))
     + " from orders group by 1) on c_custkey = o_custkey")
def dfs_depth1(spark, sf_dir):
    return _checked(D.dfs(entity_set(spark, sf_dir, with_lines=False), max_depth=1))


@key("dfs_depth2", "select c_custkey, c_acctbal, coalesce(\"COUNT(orders)\", 0)::bigint as \"COUNT(orders)\", "
     + ", ".join(f'"{n}"' for n, _ in _ORDER_FEATURES)
     + f" from customer left join ({_DEPTH2}) on c_custkey = o_custkey")
def dfs_depth2(spark, sf_dir):
    return _checked(D.dfs(entity_set(spark, sf_dir), max_depth=2))


@key("entity_check", """
select 'customer' as parent, 'orders' as child, count(*)::bigint as n_rows,
       count(*) filter (o_custkey not in (select c_custkey from customer))::bigint as orphans from orders
union all select 'orders', 'lineitem', count(*), count(*) filter (l_orderkey not in (select o_orderkey from orders)) from lineitem""")
def entity_check(spark, sf_dir):
    return entity_set(spark, sf_dir).check()


_ALL_ORDER_FEATURES = ["COUNT(orders)", *(n for n, _ in _ORDER_FEATURES)]


@key("dfs_defs", f"""
with f as (select unnest(['sum', 'mean', 'max', 'min', 'std']) as fn),
line as (select upper(fn) || '(lineitem.' || c || ')' as base from f, (select unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as c)
         union all select 'COUNT(lineitem)'),
defs as (select 'COUNT(orders)' as name, 'size' as fn, null as input, null as base, 1 as depth
         union all select upper(fn) || '(orders.o_totalprice)', fn, 'o_totalprice', null, 1 from f
         union all select upper(fn) || '(orders.' || base || ')', fn, null, base, 2 from f, line),
matrix as (select coalesce("COUNT(orders)", 0) as "COUNT(orders)", {", ".join(f'"{n}"' for n, _ in _ORDER_FEATURES)}
           from customer left join ({_DEPTH2}) on c_custkey = o_custkey),
filled as ({" union all ".join(f"""select '{n}' as name, count("{n}")::bigint as n_values from matrix""" for n in _ALL_ORDER_FEATURES)})
select name, fn, 'orders' as entity, input, base, null::varchar as condition, depth::int as depth, n_values from defs join filled using (name)""")
def dfs_defs(spark, sf_dir):
    """Each definition beside the number of customers that have a value for it."""
    from featforge.operators.rollup import per_column
    es = entity_set(spark, sf_dir)
    matrix = D.dfs(es).drop("c_custkey", "c_acctbal")
    filled = per_column(matrix, matrix.columns, {"n_values": lambda c: f"count({c})"})
    defs = D.definitions_table(es, D.dfs(es, features_only=True))
    return defs.join(filled, defs["name"] == filled["column"]).drop("column")


@key("dfs_transforms", f"""
with f as (select c_custkey, c_acctbal, count(o_orderkey) as n, max(o_totalprice) as v
           from customer left join orders on c_custkey = o_custkey group by 1, 2)
select c_custkey, n::bigint as "COUNT(orders)", round(v * {NUDGE}, 4) as "MAX(orders.o_totalprice)",
       (n - lag(n) over w)::bigint as "DIFF(COUNT(orders))",
       round((v - lag(v) over w) * {NUDGE}, 4) as "DIFF(MAX(orders.o_totalprice))",
       (sum(n) over w)::bigint as "CUM_SUM(COUNT(orders))",
       case when v is not null then round((sum(v) over w) * {NUDGE}, 2) end as "CUM_SUM(MAX(orders.o_totalprice))",
       round(sum(n) over w / count(*) over w::double, 9) as "CUM_MEAN(COUNT(orders))",
       case when v is not null then round((avg(v) over w) * {NUDGE}, 4) end as "CUM_MEAN(MAX(orders.o_totalprice))",
       round((rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0::double) / count(*) over (), 9)
           as "PERCENTILE(COUNT(orders))",
       round((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double) / count(*) over (), 9)
           as "PERCENTILE(MAX(orders.o_totalprice))"
from f window w as (order by c_custkey)""")
def dfs_transforms(spark, sf_dir):
    es = entity_set(spark, sf_dir, with_lines=False)
    out = D.dfs(es, agg=["count", "max"], max_depth=1, trans=D.TRANSFORMS).drop("c_acctbal")
    prices = rounded(out, {"CUM_SUM(MAX(orders.o_totalprice))": 2, "CUM_MEAN(MAX(orders.o_totalprice))": 4,
                           "DIFF(MAX(orders.o_totalprice))": 4, "MAX(orders.o_totalprice)": 4}, nudge=True)
    return rounded(prices, 9)


@key("dfs_where", "select c_custkey, c_acctbal, coalesce(n, 0)::bigint as \"COUNT(orders)\", round(s, 2) as \"SUM(orders.o_totalprice)\", "
     "round(m, 6) as \"MEAN(orders.o_totalprice)\", " + ", ".join(
         f"coalesce(n_{v}, 0)::bigint as \"COUNT(orders WHERE o_orderstatus = {v})\", "
         f"round(s_{v}, 2) as \"SUM(orders.o_totalprice WHERE o_orderstatus = {v})\", "
         f"round(m_{v}, 6) as \"MEAN(orders.o_totalprice WHERE o_orderstatus = {v})\"" for v in "FO")
     + " from customer left join (select o_custkey, count(*) as n, coalesce(sum(o_totalprice), 0) as s, avg(o_totalprice) as m, "
     + ", ".join(f"count(*) filter (o_orderstatus = '{v}') as n_{v}, coalesce(sum(o_totalprice) filter (o_orderstatus = '{v}'), 0) as s_{v}, "
                 f"avg(o_totalprice) filter (o_orderstatus = '{v}') as m_{v}" for v in "FO")
     + " from orders group by 1) on c_custkey = o_custkey")
def dfs_where(spark, sf_dir):
    out = D.dfs(entity_set(spark, sf_dir, with_lines=False), agg=["count", "sum", "mean"], max_depth=1,
                where={"orders": {"o_orderstatus": ["F", "O"]}})
    return rounded(out.select(*[F.round(F.col(f"`{c}`"), 2).alias(c) if c.startswith("SUM") else F.col(f"`{c}`")
                                for c in out.columns]))


@key("combine_features", """
select c_custkey, c_acctbal, coalesce(n, 0)::bigint as "COUNT(orders)", round(m, 6) as "MAX(orders.o_totalprice)"
from customer left join (select o_custkey, count(*) as n, max(o_totalprice) as m from orders where o_orderstatus = 'P' group by 1)
     on c_custkey = o_custkey""")
def combine_features(spark, sf_dir):
    manual = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    automatic = (table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey"))
                 .agg(F.count(F.lit(1)).alias("COUNT(orders)"), F.max("o_totalprice").alias("MAX(orders.o_totalprice)"),
                      F.first(F.lit(0.0)).alias("c_acctbal")))
    return rounded(D.combine_features(manual, automatic, "c_custkey"))


@key("expand_nonlinear", """
select l_orderkey, l_linenumber, l_tax, l_discount, 1 / nullif(l_tax, 0) as "1/l_tax", 1 / nullif(l_discount, 0) as "1/l_discount",
       round(case when l_tax > 0 then ln(l_tax) end, 9) as "log(l_tax)", round(case when l_discount > 0 then ln(l_discount) end, 9) as "log(l_discount)",
       round(sqrt(l_tax), 9) as "sqrt(l_tax)", round(sqrt(l_discount), 9) as "sqrt(l_discount)",
       round(l_tax * l_tax, 9) as "l_tax**2", round(l_discount * l_discount, 9) as "l_discount**2",
       abs(l_tax) as "abs(l_tax)", abs(l_discount) as "abs(l_discount)", round(l_tax * l_discount, 9) as "l_tax*l_discount"
from lineitem""")
def expand_nonlinear(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount")
    out = D.expand_nonlinear(df, ["l_tax", "l_discount"])
    exact = ("1/", "abs")
    return out.select(*[F.col(f"`{c}`") if c in df.columns or c.startswith(exact) else F.round(F.col(f"`{c}`"), 9).alias(c)
                        for c in out.columns])


@key("l1_select")
def l1_select(spark, sf_dir):
    """Values per feature that an L1-penalised model keeps when it tells generous lines from others."""
    from featforge.operators.rollup import per_column
    df = table(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_tax").withColumn(
        "label", (F.col("l_discount") > F.col("l_tax")).cast("int"))
    wide = D.expand_nonlinear(df, ["l_quantity", "l_discount", "l_tax"])
    names = D.l1_select(wide, [c for c in wide.columns if c != "label"], "label")
    return per_column(wide, names, {"n_values": lambda c: f"count({c})"})


@key("dfs_mode", """
with m as (select o_custkey, o_orderpriority as v, count(*) as n from orders group by 1, 2),
s as (select o_custkey, o_orderstatus as v, count(*) as n from orders group by 1, 2),
a as (select o_custkey, arg_min(v, struct_pack(n := -n, v := v)) as p, count(v) as np from m group by 1),
b as (select o_custkey, arg_min(v, struct_pack(n := -n, v := v)) as s, count(v) as ns from s group by 1)
select c_custkey, (select count(*) from orders where o_custkey = c_custkey)::bigint as "COUNT(orders)",
       s as "MODE(orders.o_orderstatus)", p as "MODE(orders.o_orderpriority)", ns::bigint as "NUNIQUE(orders.o_orderstatus)",
       np::bigint as "NUNIQUE(orders.o_orderpriority)", l.len::bigint as "LONGEST(orders.o_orderstatus)",
       l.lenp::bigint as "LONGEST(orders.o_orderpriority)"
from customer left join a on a.o_custkey = c_custkey left join b on b.o_custkey = c_custkey
left join (select o_custkey, max(length(o_orderstatus)) as len, max(length(o_orderpriority)) as lenp from orders group by 1) l
     on l.o_custkey = c_custkey""")
def dfs_mode(spark, sf_dir):
    """Aggregates of text columns, with one from a registry."""
    from pyspark.sql import types as T

    from featforge.operators.rollup import PrimitiveRegistry
    registry = PrimitiveRegistry()
    registry.register("longest", [T.StringType], T.LongType(), lambda c: F.max(F.length(c)))
    es = D.EntitySet("customer")
    es.add("customer", table(spark, sf_dir, "customer", "c_custkey"), "c_custkey")
    es.add("orders", table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    es.relate("customer", "c_custkey", "orders", "o_custkey")
    return D.dfs(es, ["count", "mode", "nunique", "longest"], max_depth=1, custom=registry.primitives())


@key("interesting_values", " union all ".join(f"""
select * from (select '{c}' as column, {c} as value, count(*)::bigint as rows, row_number() over (order by count(*) desc, {c})::int as rank
               from lineitem where {c} is not null group by 2 qualify count(*) >= 0.05 * (select count(*) from lineitem)) where rank <= 3"""
    for c in ("l_returnflag", "l_linestatus")) + """
union all select * from (select 'key' as column, l_partkey::varchar as value, count(*)::bigint as rows, 1::int as rank from lineitem
                         group by 2 having count(*) >= 0.05 * (select count(*) from lineitem)) where rank <= 3""")
def interesting_values(spark, sf_dir):
    """Heavy hitters by a sketch, counted exactly; a column without any gives none."""
    df = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_partkey")
    df = df.select("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("key"))
    return D.interesting_values(df, k=3, min_share=0.05)


@key("dfs_where_found", "select c_custkey, coalesce(n, 0)::bigint as \"COUNT(orders)\", " + ", ".join(
    f"coalesce(n_{v}, 0)::bigint as \"COUNT(orders WHERE o_orderstatus = {v})\"" for v in "FOP")
    + " from customer left join (select o_custkey, count(*) as n, " + ", ".join(
    f"count(*) filter (o_orderstatus = '{v}') as n_{v}" for v in "FOP") + " from orders group by 1) on c_custkey = o_custkey")
def dfs_where_found(spark, sf_dir):
    """Conditions that the synthesis finds by itself: the statuses that at least a tenth of the orders have."""
    es = D.EntitySet("customer")
    es.add("customer", table(spark, sf_dir, "customer", "c_custkey"), "c_custkey")
    es.add("orders", table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    es.relate("customer", "c_custkey", "orders", "o_custkey")
    return D.dfs(es, ["count"], max_depth=1, where=D.where_values(es, k=3, min_share=0.1))
