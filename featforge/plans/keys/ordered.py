"""Window-like features over whole ordered tables."""

from pyspark.sql import functions as F

from featforge.operators import ordered as W
from featforge.operators.selection import value_at_rank
from featforge.plans.keys import NUDGE, key, rounded, table

_EVENTS = "(select event_id, user_id, ts, case when event_type <> 'error' then value end as value from events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


@key("win_diff", f"""
select event_id, round(value - lag(value) over (order by ts), 6) as "DIFF(value)",
       round(value - lag(value) over (partition by user_id order by ts), 6) as user_diff from {_EVENTS}""")
def win_diff(spark, sf_dir):
    df = W.diff(_events(spark, sf_dir), ["value"], ["ts"])
    by_user = W.diff(df.withColumnRenamed("DIFF(value)", "_all"), ["value"], ["ts"], by=["user_id"])
    return rounded(by_user.select("event_id", F.col("_all").alias("DIFF(value)"), F.col("`DIFF(value)`").alias("user_diff")))


@key("win_cum_sum", f"""
select event_id, case when value is not null then round(sum(value) over (order by ts), 4) end as "CUM_SUM(value)" from {_EVENTS}""")
def win_cum_sum(spark, sf_dir):
    return rounded(W.cum_sum(_events(spark, sf_dir), ["value"], ["ts"]).select("event_id", "`CUM_SUM(value)`"), 4)


@key("win_cum_mean", f"""
select event_id, case when value is not null then round((avg(value) over (partition by user_id order by ts)) * {NUDGE}, 7) end as "CUM_MEAN(value)"
from {_EVENTS}""")
def win_cum_mean(spark, sf_dir):
    return rounded(W.cum_mean(_events(spark, sf_dir), ["value"], ["ts"], by=["user_id"]).select("event_id", "`CUM_MEAN(value)`"), 7, nudge=True)


@key("win_percentile", f"""
select event_id, round((rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double)
       / (select count(value) from {_EVENTS}), 9) as "PERCENTILE(value)"
from {_EVENTS} where value is not null
union all select event_id, null from {_EVENTS} where value is null""")
def win_percentile(spark, sf_dir):
    return rounded(W.percentile_rank(_events(spark, sf_dir), "value").select("event_id", "`PERCENTILE(value)`"), 9)


@key("rank_cut", """
with s as (select p_brand, round(sum(l_extendedprice), 2) as score from lineitem join part on l_partkey = p_partkey group by 1),
r as (select score, row_number() over (order by score desc) as r, count(*) over () as n from s)
select score from r where r = floor(n * 0.4::double) + 1""")
def rank_cut(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    scores = lines.join(brands, "l_partkey").groupBy("p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return value_at_rank(scores, "score", 0.4)
