"""Encoding and imputation."""

from pyspark.sql import functions as F

from featforge.operators import encode as E
from featforge.operators import impute as I
from featforge.operators.rows import null_sentinel
from featforge.plans.keys import key, rounded, table

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")  # fixed values of the test data


def _orders(spark, sf_dir, *columns):
    """Orders with status P taken for missing."""
    return null_sentinel(table(spark, sf_dir, "orders", *columns), ["o_orderstatus"], "P")


@key("one_hot", """
select o_orderkey, (o_orderstatus is not distinct from 'F')::int as "o_orderstatus_F",
       (o_orderstatus is not distinct from 'O')::int as "o_orderstatus_O", (o_orderstatus is null)::int as o_orderstatus_nan
from (select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders)""")
def one_hot(spark, sf_dir):
    return E.one_hot(_orders(spark, sf_dir, "o_orderkey", "o_orderstatus"))[0]


@key("one_hot_prefix", """
select o_orderkey, o_orderstatus, coalesce(o_orderstatus = 'O', false)::int as "ca__O"
from (select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders)""")
def one_hot_prefix(spark, sf_dir):
    return E.one_hot(_orders(spark, sf_dir, "o_orderkey", "o_orderstatus"), null_category=False,
                     prefix={"o_orderstatus": "ca_"}, drop_first=True, keep_source=True)[0]


_CODES = """(select o_orderstatus, (row_number() over (order by min(o_orderkey)) - 1)::int as code
 from (select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders)
 where o_orderstatus is not null group by 1)"""


@key("factorize", f"""
select o.o_orderkey, coalesce(c.code, -1)::int as o_orderstatus
from orders o left join {_CODES} c on nullif(o.o_orderstatus, 'P') = c.o_orderstatus""")
def factorize(spark, sf_dir):
    return E.factorize(_orders(spark, sf_dir, "o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])[0]


@key("factorize_apply", """
with codes as (select event_type, (row_number() over (order by min(ts)) - 1)::int as code from events
               where event_type <> 'error' group by 1)
select e.event_id, coalesce(c.code, -1)::int as event_type from events e left join codes c using (event_type)""")
def factorize_apply(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    codes = E.factorize_map(events.where("event_type <> 'error'"), "event_type", ["ts"])
    return E.apply_codes(events.select("event_id", "event_type"), "event_type", codes)


@key("ordinal_encode", """
with named as (select c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'Unknown') as c_mktsegment from customer)
select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::int as c_mktsegment from named""")
def ordinal_encode(spark, sf_dir):
    df = null_sentinel(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), ["c_mktsegment"], "MACHINERY")
    return E.ordinal_encode(df, "c_mktsegment")


@key("auto_encode", "select p_partkey, (dense_rank() over (order by p_brand) - 1)::double as p_brand, "
     + ", ".join(f"(p_type = '{t}')::int as \"p_type_{t}\"" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
     + " from part")
def auto_encode(spark, sf_dir):
    return E.auto_encode(table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type"))


_DIRTY = """(select l_orderkey, nullif(l_quantity, 50) as l_quantity, nullif(l_returnflag, 'R') as l_returnflag,
              case when l_linenumber = 7 then l_tax end as l_tax from lineitem)"""


def _dirty(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_tax", "l_linenumber")
    df = null_sentinel(null_sentinel(df, ["l_quantity"], 50.0), ["l_returnflag"], "R")
    return df.withColumn("l_tax", F.when(F.col("l_linenumber") == 7, F.col("l_tax"))).drop("l_linenumber")


_MODE = "(select l_returnflag from d where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)"


@key("impute_median_mode", f"""
with d as {_DIRTY}
select l_orderkey, coalesce(l_quantity, (select median(l_quantity) from d)) as l_quantity,
       coalesce(l_returnflag, {_MODE}) as l_returnflag
from d""")
def impute_median_mode(spark, sf_dir):
    return I.impute_median_mode(_dirty(spark, sf_dir))


@key("impute_fit_apply", f"""
with d as {_DIRTY}, fit as (select * from d where l_orderkey % 2 = 0)
select round(coalesce(l_quantity, (select avg(l_quantity) from fit)), 6) as l_quantity,
       coalesce(l_returnflag, {_MODE.replace("from d", "from fit")}) as l_returnflag,
       round(coalesce(l_tax, (select avg(l_tax) from fit)), 6) as l_tax
from d""")
def impute_fit_apply(spark, sf_dir):
    """Fitted on the lines of even orders (the training part), applied to all lines."""
    df = _dirty(spark, sf_dir)
    train = df.where("l_orderkey % 2 = 0")
    return rounded(I.Imputer("mean").fit(train, ["l_quantity", "l_returnflag", "l_tax"]).transform(df).drop("l_orderkey"))


@key("repair_target", """
with d as (select doc_id, quality, toxic from documents left join labels using (doc_id))
select doc_id, coalesce(quality, (select quality from d where quality is not null group by 1 order by count(*) desc, 1
       limit 1)) as quality, toxic
from d""")
def repair_target(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return I.repair_target(df, "quality").select("doc_id", "quality", "toxic")


@key("rollup_encoded", """
select case when l_returnflag in ('A', 'N', 'R') then 'l_returnflag' else 'other' end as feature,
       round(sum(l_extendedprice), 2) as importance
from lineitem group by 1 union all
select 'l_discount', round(sum(l_discount), 2) from lineitem""")
def rollup_encoded(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_discount")
    model = E.fit_one_hot(df, ["l_returnflag"], null_category=False)
    per_code = df.groupBy(F.concat(F.lit("l_returnflag_"), "l_returnflag").alias("feature")).agg(
        F.sum("l_extendedprice").alias("importance"))
    plain = df.agg(F.sum("l_discount").alias("importance")).select(F.lit("l_discount").alias("feature"), "importance")
    mapping = {name: "l_returnflag" for name in model.new_columns()}
    return rounded(E.rollup_encoded(per_code.unionByName(plain), mapping), 2)


@key("clean_dataset", """
with d as (select o_orderkey, o_orderstatus, case when o_orderpriority = '5-LOW' then null else o_totalprice end as price,
                  nullif(o_orderpriority, '1-URGENT') as o_orderpriority,
                  case when o_custkey % 7 = 0 then null else (o_totalprice > 250000)::int end as target from orders)
select o_orderkey, round(coalesce(price, (select median(price) from d)), 6) as price,
       coalesce(target, (select target from d where target is not null group by 1 order by count(*) desc, 1 limit 1)) as target,
       (coalesce(o_orderpriority, 'Unknown') = 'Unknown')::int::double as "o_orderpriority_Unknown", """
     + ", ".join(f"(coalesce(o_orderpriority, 'Unknown') = '{p}')::int::double as \"o_orderpriority_{p}\"" for p in _PRIORITIES[1:])
     + ", " + ", ".join(f"(o_orderstatus = '{s}')::int::double as \"o_orderstatus_{s}\"" for s in "FOP")
     + " from d")
def clean_dataset(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    dirty = df.select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderpriority") == "5-LOW", float("inf")).otherwise(F.col("o_totalprice")).alias("price"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"),
        F.when(F.col("o_custkey") % 7 == 0, None).otherwise((F.col("o_totalprice") > 250000).cast("int")).alias("target"))
    return rounded(I.clean_dataset(dirty, "target", exclude=["o_orderkey"]))


