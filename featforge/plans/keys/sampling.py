"""Sampling, splits, folds. Which rows are drawn depends on the hash, so the checks compare exact group sizes."""

from pyspark.sql import functions as F

from featforge.operators import sampling as M
from featforge.operators.profile import size_report
from featforge.plans.keys import key, table

_RANK = "row_number() over (order by (n * q / t) - floor(n * q / t) desc, label::varchar)"


def _quota(q, source):
    """Largest-remainder shares of q rows over the classes of ``source`` (label, n)."""
    return f"""
select label, (floor(n * q / t) + ({_RANK} <= q - sum(floor(n * q / t)) over ())::int)::bigint as n_rows
from (select label, n::double as n, sum(n) over ()::double as t, {q} as q from ({source}))"""


_STATUS = "select o_orderstatus as label, count(*) as n from orders group by 1"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")


@key("sample_n", "select least(3000, count(*))::bigint as n_rows, least(3000, count(*))::bigint as n_keys from orders")
def sample_n(spark, sf_dir):
    drawn = M.sample_n(_orders(spark, sf_dir), 3000, "o_orderkey")
    return drawn.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"))


@key("sample_stratified", _quota("(select least(2000, count(*)) from orders)", _STATUS))
def sample_stratified(spark, sf_dir):
    drawn = M.sample_stratified(_orders(spark, sf_dir), 2000, "o_orderstatus", "o_orderkey")
    return drawn.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


@key("sampling_profile", """
select 'orders' as dataset, least(5000, count(*))::bigint as n_rows from orders
union all select 'lineitem', least(5000, count(*)) from lineitem union all select 'customer', least(5000, count(*)) from customer""")
def sampling_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    data = {"orders": _orders(spark, sf_dir), "lineitem": lines, "customer": table(spark, sf_dir, "customer")}
    drawn = M.apply_profile(data, "Quick Exploration", {"orders": "o_orderkey", "lineitem": lines.columns,
                                                        "customer": "c_custkey"}, "orders", "o_orderstatus")
    out = None
    for name, df in drawn.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@key("split_train_test", f"""
with test as ({_quota("(select ceil(count(*) * 0.2) from orders)", _STATUS)})
select label, 'test' as split, n_rows from test
union all select label, 'train', n - n_rows from test join ({_STATUS}) using (label)""")
def split_train_test(spark, sf_dir):
    marked = M.add_split(_orders(spark, sf_dir), 0.2, "o_orderkey", stratify="o_orderstatus")
    return marked.groupBy(F.col("o_orderstatus").alias("label"), "split").agg(F.count(F.lit(1)).alias("n_rows"))


@key("assign_folds", f"""
select label, fold::int as fold, (((n * (fold + 1) + 4) // 5) - ((n * fold + 4) // 5))::bigint as n_rows
from ({_STATUS}), (select unnest([0, 1, 2, 3, 4]) as fold)""")
def assign_folds(spark, sf_dir):
    folds = M.assign_folds(_orders(spark, sf_dir), 5, "o_orderkey", stratify="o_orderstatus")
    return folds.groupBy(F.col("o_orderstatus").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@key("permute_label", "select o_orderstatus, count(*)::bigint as n_rows from orders group by 1")
def permute_label(spark, sf_dir):
    shuffled = M.permute_label(_orders(spark, sf_dir), "o_orderkey", "o_orderstatus", seed=7)
    return shuffled.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


# The same operators in an order that SQL can compute, so that the drawn rows themselves are compared.
_SEED = M.PortableSeed(42)
_HASH = "md5(o_orderkey || ':42')[:15]"
_IN_CLASS = f"row_number() over (partition by o_orderstatus order by {_HASH})"


@key("sample_n_rows", f"select o_orderkey from orders qualify row_number() over (order by {_HASH}) <= 3000")
def sample_n_rows(spark, sf_dir):
    return M.sample_n(_orders(spark, sf_dir), 3000, "o_orderkey", _SEED).select("o_orderkey")


@key("sample_stratified_rows", f"""
with q as ({_quota("(select least(2000, count(*)) from orders)", _STATUS)})
select o_orderkey, o_orderstatus from orders join q on label = o_orderstatus qualify {_IN_CLASS} <= n_rows""")
def sample_stratified_rows(spark, sf_dir):
    return M.sample_stratified(_orders(spark, sf_dir), 2000, "o_orderstatus", "o_orderkey", _SEED).select("o_orderkey", "o_orderstatus")


@key("split_rows", f"""
with q as ({_quota("(select ceil(count(*) * 0.2) from orders)", _STATUS)})
select o_orderkey, if({_IN_CLASS} <= n_rows, 'test', 'train') as split from orders join q on label = o_orderstatus""")
def split_rows(spark, sf_dir):
    marked = M.add_split(_orders(spark, sf_dir), 0.2, "o_orderkey", _SEED, stratify="o_orderstatus")
    return marked.select("o_orderkey", "split")


@key("fold_rows", f"""
select o_orderkey, (({_IN_CLASS} - 1) * 5 // count(*) over (partition by o_orderstatus))::int as fold from orders""")
def fold_rows(spark, sf_dir):
    folds = M.assign_folds(_orders(spark, sf_dir), 5, "o_orderkey", _SEED, stratify="o_orderstatus")
    return folds.select("o_orderkey", "fold")


@key("permuted_rows", f"""
with c as (select o_orderstatus as label, count(*) as n from orders group by 1),
b as (select label, sum(n) over (order by label) as upto, sum(n) over (order by label) - n as past from c),
r as (select o_orderkey, row_number() over (order by {_HASH}) as rank from orders)
select o_orderkey, label as o_orderstatus from r join b on rank > past and rank <= upto""")
def permuted_rows(spark, sf_dir):
    return M.permute_label(_orders(spark, sf_dir), "o_orderkey", "o_orderstatus", _SEED).select("o_orderkey", "o_orderstatus")


# The same with thousands of classes of a few rows each.
_WIDE = "select *, o_orderkey % 5000 as c from orders"
_WIDE_SIZES = f"select c as label, count(*) as n from ({_WIDE}) group by 1"
_IN_WIDE = f"row_number() over (partition by c order by {_HASH})"


def _wide(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey").withColumn("c", F.col("o_orderkey") % 5000)


@key("stratified_wide_rows", f"""
with q as ({_quota("(select least(800, count(*)) from orders)", _WIDE_SIZES)})
select o_orderkey, c from ({_WIDE}) join q on label = c qualify {_IN_WIDE} <= n_rows""")
def stratified_wide_rows(spark, sf_dir):
    return M.sample_stratified(_wide(spark, sf_dir), 800, "c", "o_orderkey", _SEED).select("o_orderkey", "c")


@key("fold_wide_rows", f"""
select o_orderkey, (({_IN_WIDE} - 1) * 3 // count(*) over (partition by c))::int as fold from ({_WIDE})""")
def fold_wide_rows(spark, sf_dir):
    return M.assign_folds(_wide(spark, sf_dir), 3, "o_orderkey", _SEED, stratify="c").select("o_orderkey", "fold")


@key("permuted_wide_rows", f"""
with r as (select o_orderkey, row_number() over (order by {_HASH}) as rank from orders),
l as (select c, row_number() over (order by c) as rank from ({_WIDE}))
select o_orderkey, c from r join l using (rank)""")
def permuted_wide_rows(spark, sf_dir):
    return M.permute_label(_wide(spark, sf_dir), "o_orderkey", "c", _SEED).select("o_orderkey", "c")


@key("size_report", """
select 'orders' as dataset, count(*)::bigint as original_rows, least(3000, count(*))::bigint as current_rows,
       least(3000, count(*)) * 100.0::double / count(*) as percent_kept, 3::int as n_columns from orders""")
def size(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return size_report({"orders": orders}, {"orders": M.sample_n(orders, 3000, "o_orderkey")})


@key("smote", """
select (c_acctbal < 0)::int as target, (select count(*) from customer where c_acctbal >= 0)::bigint as n_rows,
       (count(*))::bigint as n_real from customer group by 1""")
def smote(spark, sf_dir):
    """Customers with a negative balance brought up to the size of the other class."""
    from featforge.operators.oversample import smote as oversample
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), (F.avg("o_totalprice") / 10000).alias("mean_price"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    data = customers.join(orders, "c_custkey", "left").fillna(0.0)
    out = oversample(data, ["n_orders", "mean_price"], "target", "c_custkey")
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.count("c_custkey").alias("n_real"))


_NEAREST = """
with d as (select a.p_partkey as id, b.p_partkey as neighbour,
                  sqrt((a.p_size - b.p_size)::double * (a.p_size - b.p_size)::double
                       + (a.p_retailprice / 100 - b.p_retailprice / 100) * (a.p_retailprice / 100 - b.p_retailprice / 100)) as distance
           from part a join part b on a.p_partkey <> b.p_partkey)
select id, neighbour, row_number() over (partition by id order by distance, neighbour)::int as rank from d
qualify row_number() over (partition by id order by distance, neighbour) <= 3"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 100).alias("price"))


@key("neighbours_exact", _NEAREST)
def neighbours_exact(spark, sf_dir):
    from featforge.operators.oversample import nearest_neighbours
    return nearest_neighbours(_parts(spark, sf_dir), "p_partkey", ["size", "price"], 3, block=64).select("id", "neighbour", "rank")


@key("neighbours_hashed", """
select count(*)::bigint as n_rows, 3 * count(*)::bigint as n_pairs, true as recalled from part""")
def neighbours_hashed(spark, sf_dir):
    """All rows have their neighbours, and at least 0.9 of the true ones of a query set are found in buckets of 64 rows."""
    from featforge.operators.oversample import hashed_neighbours, measured_recall
    parts = _parts(spark, sf_dir)
    found = hashed_neighbours(parts, "p_partkey", ["size", "price"], 3, leaf=64).cache()
    recall = measured_recall(parts, "p_partkey", ["size", "price"], found, 3)
    return found.agg(F.countDistinct("id").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs")).withColumn("recalled", F.lit(recall >= 0.9))

