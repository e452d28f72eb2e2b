"""Feature selection on importance tables that Spark derives from the orders: one feature per customer, one
permuted run per month of the year."""

from pyspark.sql import functions as F

from featforge.operators import selection as S
from featforge.plans.keys import key, rounded, table

_ACTUAL = """(select 'f' || o_custkey as feature, count(*)::double as importance_split, round(avg(o_totalprice) / 1000, 3) as importance_gain
 from orders group by 1)"""
_NULL = """(select 'f' || o_custkey as feature, month(o_orderdate) as run, count(*)::double as importance_split,
 round(avg(o_totalprice) / 2000, 3) as importance_gain from orders where o_orderstatus = 'O' group by 1, 2)"""
_SCORE = ("case when p.{k} is null then a.importance_{k} else ln(1e-10::double + a.importance_{k} / (1 + p.{k})) end as {k}_score")
_SCORES = f"""(select a.feature, {_SCORE.format(k="split")}, {_SCORE.format(k="gain")}
 from {_ACTUAL} a left join (select feature, quantile_cont(importance_split, 0.75) as split, quantile_cont(importance_gain, 0.75) as gain
 from {_NULL} group by 1) p using (feature))"""


def scores(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("feature", F.concat(F.lit("f"), "o_custkey"))
    actual = orders.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("importance_split"),
                                           F.round(F.avg("o_totalprice") / 1000, 3).alias("importance_gain"))
    null = orders.where("o_orderstatus = 'O'").groupBy("feature", F.month("o_orderdate").alias("run")).agg(
        F.count(F.lit(1)).cast("double").alias("importance_split"), F.round(F.avg("o_totalprice") / 2000, 3).alias("importance_gain"))
    return S.importance_scores(actual, null)


@key("importance_scores", f"select feature, round(split_score, 9) as split_score, round(gain_score, 9) as gain_score from {_SCORES}")
def importance_scores(spark, sf_dir):
    return rounded(scores(spark, sf_dir), 9)


def _at_rank(k):
    return (f"(select {k}_score from (select {k}_score, row_number() over (order by {k}_score desc) as r, count(*) over () as n "
            f"from s) where r = floor(n * 0.4::double) + 1)")


_THRESHOLDS = f"""t as (select {_at_rank("split")} as ts, {_at_rank("gain")} as tg),
p as (select count_if(split_score > ts or gain_score > tg) as passed, count(*) as n from s, t)"""


def _threshold(k, rank):
    q = lambda x: f"quantile_cont({k}_score, {x})"
    return (f"case when any_value(passed) = 0 then {q(0.8)} when any_value(passed) < 0.05 * any_value(n) then {q(0.9)} "
            f"when any_value(passed) > 0.9 * any_value(n) then {q(0.67)} else any_value({rank}) end")


_AUTO = f"""s as (select feature, round(split_score, 9) as split_score, round(gain_score, 9) as gain_score from {_SCORES}), {_THRESHOLDS},
h as (select {_threshold("split", "ts")} as split_threshold, {_threshold("gain", "tg")} as gain_threshold from s, t, p)"""


@key("score_thresholds", f"with {_AUTO} select * from h")
def score_thresholds(spark, sf_dir):
    return S.score_thresholds(importance_scores(spark, sf_dir))


_SELECTED = f"""{_AUTO}, hits as (select feature from s, h where split_score > split_threshold or gain_score > gain_threshold),
q as (select (count(*) // 4) as quarter from s),
best as (select feature from (select feature, row_number() over (order by split_score desc, feature) as r from s), q where r <= quarter
         union select feature from (select feature, row_number() over (order by gain_score desc, feature) as r from s), q where r <= quarter),
sel as (select feature from hits where (select count(*) from hits) <= 0.75 * (select count(*) from s)
        union all select feature from best where (select count(*) from hits) > 0.75 * (select count(*) from s))"""


@key("select_features", f"with {_SELECTED} select feature from sel")
def select_features(spark, sf_dir):
    return S.select_features(importance_scores(spark, sf_dir))


@key("apply_selection", "select l_orderkey, l_quantity, l_tax from lineitem")
def apply_selection(spark, sf_dir):
    """Columns of lineitem chosen by name, one of them absent."""
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_tax")
    return S.apply_selection(df, ["l_tax", "l_quantity", "absent"], keep=["l_orderkey"])


@key("selection_summary", f"""with {_SELECTED}
select (select count(*) from s)::bigint as original, (select count(*) from sel)::bigint as selected,
       round(((select count(*) from s) - (select count(*) from sel)) * 100.0::double / (select count(*) from s), 9) as reduction_percent""")
def selection_summary(spark, sf_dir):
    table_of_scores = importance_scores(spark, sf_dir)
    return rounded(S.selection_summary(table_of_scores, S.select_features(table_of_scores)), 9)
