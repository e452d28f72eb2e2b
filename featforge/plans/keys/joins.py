"""Joins, sorting, limits and set operations."""

from pyspark.sql import functions as F

from featforge.operators import joins as J
from featforge.operators.rollup import group_agg
from featforge.plans.keys import key, rounded, table


@key("left_join_agg", """
select c_custkey, c_mktsegment, n.o_count, round(n.o_total, 4) as o_total
from customer left join (select o_custkey, count(*)::bigint as o_count, sum(o_totalprice) as o_total from orders
                         where o_orderstatus = 'P' group by 1) n on c_custkey = n.o_custkey""")
def left_join_agg(spark, sf_dir):
    agg = (table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey"))
           .agg(F.count(F.lit(1)).alias("o_count"), F.sum("o_totalprice").alias("o_total")))
    return rounded(J.attach(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), agg, "c_custkey"), 4)


@key("merge_suffix", """
select a.o_orderkey, a.v as v_x, b.v as v_y
from (select o_orderkey, o_totalprice as v from orders) a
left join (select l_orderkey, count(*)::bigint as v from lineitem group by 1) b on a.o_orderkey = b.l_orderkey""")
def merge_suffix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return J.merge_suffix(orders, lines, ["o_orderkey"])


@key("group_count_back", """
select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey)::bigint as n_lines from lineitem""")
def group_count_back(spark, sf_dir):
    return J.group_count_back(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "n_lines")


def _register_merges():
    for how in J.JOIN_TYPES:
        @key(f"merge_{how}", f"""
select s_suppkey, s_nationkey, c_custkey, c_nationkey, segment
from (select s_suppkey, s_nationkey from supplier) s {'full outer' if how == 'outer' else how} join
     (select max(c_custkey) as c_custkey, c_nationkey + 5 as c_nationkey, c_mktsegment as segment from customer group by 2, 3) c
     on s.s_nationkey = c.c_nationkey""")
        def run(spark, sf_dir, how=how):
            customers = (table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 5).alias("c_nationkey"),
                                                                  F.col("c_mktsegment").alias("segment"))
                         .agg(F.max("c_custkey").alias("c_custkey")))
            return J.merge(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), customers, how,
                           left_on="s_nationkey", right_on="c_nationkey")


_register_merges()


@key("assemble_star", """
select o.o_orderkey, l.n_lines, round(l.revenue, 4) as revenue, r.n_returned, m.last_ship
from orders o
left join (select l_orderkey, count(*)::bigint as n_lines, sum(l_extendedprice) as revenue from lineitem group by 1) l
     on o.o_orderkey = l.l_orderkey
left join (select l_orderkey, count(*)::bigint as n_returned from lineitem where l_returnflag = 'R' group by 1) r
     on o.o_orderkey = r.l_orderkey
left join (select l_orderkey, max(l_shipdate)::date as last_ship from lineitem where l_linestatus = 'F' group by 1) m
     on o.o_orderkey = m.l_orderkey""")
def assemble_star(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = [
        lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("revenue")),
        lines.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_returned")),
        lines.where("l_linestatus = 'F'").groupBy("o_orderkey").agg(F.max("l_shipdate").cast("date").alias("last_ship")),
    ]
    return rounded(J.assemble(table(spark, sf_dir, "orders", "o_orderkey"), parts, "o_orderkey"), 4)


@key("attach_target", """
select o_custkey, round(avg(o_totalprice), 6) as mean_price, any_value((c_acctbal < 0)::int) as target
from orders left join customer on o_custkey = c_custkey group by 1""")
def attach_target(spark, sf_dir):
    features = group_agg(table(spark, sf_dir, "orders"), "o_custkey", {"o_totalprice": ["mean"]}).select(
        "o_custkey", F.col("o_totalprice_MEAN").alias("mean_price"))
    labelled = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return rounded(J.attach_target(features, labelled, "o_custkey", "target"))


@key("semi_topk", """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
where l_partkey in (select l_partkey from lineitem group by 1 order by round(sum(l_extendedprice), 2) desc, l_partkey limit 40)""")
def semi_topk(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    best = J.top_k(lines.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")), "total", 40,
                   tiebreak=["l_partkey"])
    return J.keep_in(lines, best.select("l_partkey"), "l_partkey").select(*lines.columns)


@key("common_keys", """
select distinct o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem)""")
def common_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.common_keys(table(spark, sf_dir, "orders", "o_orderkey"), lines, "o_orderkey")


@key("sort_multi", """
select o_custkey, o_orderkey, o_orderdate::date as o_orderdate from orders order by o_custkey, o_orderdate desc, o_orderkey""")
def sort_multi(spark, sf_dir):
    return (table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
            .orderBy("o_custkey", F.desc("o_orderdate"), "o_orderkey"))


@key("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_k(spark, sf_dir):
    return J.top_k(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", 50, tiebreak=["o_orderkey"])


@key("bottom_k", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20")
def bottom_k(spark, sf_dir):
    return J.top_k(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", 20, ascending=True,
                   tiebreak=["o_orderkey"])


@key("limit_n", "select event_id, event_type, value from events order by ts limit 1000")
def limit_n(spark, sf_dir):
    return J.first_rows(table(spark, sf_dir, "events"), 1000, ["ts"]).select("event_id", "event_type", "value")


@key("union_missing", """
select doc_id, lang, quality from documents join labels using (doc_id)
union all select doc_id, lang, null from documents where doc_id not in (select doc_id from labels)""")
def union_missing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return J.union_by_name(docs.join(labels, "doc_id"), docs.join(labels, "doc_id", "left_anti"))


@key("union_all", "select l_orderkey, l_linenumber, l_returnflag from lineitem")
def union_all(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return J.union_all([lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"),
                        lines.where("l_returnflag not in ('A', 'N')")])


_URGENT = "select o_custkey from orders where o_orderpriority = '1-URGENT'"
_OPEN = "select o_custkey from orders where o_orderstatus = 'O'"


def _key_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    return (orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"),
            orders.where("o_orderstatus = 'O'").select("o_custkey"))


@key("set_union", f"{_URGENT} union {_OPEN}")
def set_union(spark, sf_dir):
    return J.set_union(*_key_sets(spark, sf_dir))


@key("set_except", f"{_URGENT} except {_OPEN}")
def set_except(spark, sf_dir):
    return J.set_except(*_key_sets(spark, sf_dir))


@key("set_intersect", f"{_URGENT} intersect {_OPEN}")
def set_intersect(spark, sf_dir):
    return J.set_intersect(*_key_sets(spark, sf_dir))
