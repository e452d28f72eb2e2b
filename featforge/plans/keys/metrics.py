"""Evaluation of a deterministic score: order price as the probability that the order is finished."""

from pyspark.sql import functions as F

from featforge.operators import metrics as V
from featforge.plans.keys import key, rounded, table

_S = """s as (select (o_orderstatus = 'F')::int as label, least(round(o_totalprice / 600000, 3), 1.0) as score,
 (o_orderkey % 5)::int as fold from orders)"""
_C = """g as (select score, count_if(label = 1) as pos, count_if(label = 0) as neg from s group by 1),
c as (select score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n
      from g window w as (order by score desc))"""


def scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.least(F.round(F.col("o_totalprice") / 600000, 3), F.lit(1.0)).alias("score"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"))


@key("roc_auc", f"""with {_S}, {_C}
select round((sum(pos * (n - fp + 0.5::double * neg))) / any_value(p * n)::double, 9) as auc from c""")
def roc_auc(spark, sf_dir):
    return rounded(V.roc_auc(scored(spark, sf_dir), "label", "score"), 9)


_CELLS = """m as (select count_if(label = 1 and score >= 0.5) as tp, count_if(label = 0 and score >= 0.5) as fp,
 count_if(label = 1 and score < 0.5) as fn, count_if(label = 0 and score < 0.5) as tn from s)"""


@key("class_metrics", f"""with {_S}, {_CELLS}
select round((tp + tn) / (tp + tn + fp + fn)::double, 9) as accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 9) as precision,
       round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 9) as recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 9) as f1 from m""")
def class_metrics(spark, sf_dir):
    return rounded(V.class_metrics(scored(spark, sf_dir), "label", "score"), 9)


@key("confusion_matrix", f"""with {_S}, {_CELLS}
select 0 as actual, 0 as predicted, tn::bigint as n from m union all select 0, 1, fp::bigint from m
union all select 1, 0, fn::bigint from m union all select 1, 1, tp::bigint from m""")
def confusion_matrix(spark, sf_dir):
    return V.confusion_matrix(scored(spark, sf_dir), "label", "score")


@key("class_report", f"""with {_S}, {_CELLS},
k as (select '1' as "class", coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1, tp + fn as support from m
      union all select '0', coalesce(tn / nullif(tn + fn, 0)::double, 0), coalesce(tn / nullif(tn + fp, 0)::double, 0),
             coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::double, 0), tn + fp from m)
select "class", round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support::bigint as support from k
union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::bigint from k
union all select 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
       round(sum(f1 * support) / sum(support), 9), sum(support)::bigint from k""")
def class_report(spark, sf_dir):
    return rounded(V.class_report(scored(spark, sf_dir), "label", "score"), 9)


@key("roc_curve", f"""with {_S}, {_C}
select score as threshold, round(fp / n::double, 9) as fpr, round(tp / p::double, 9) as tpr from c""")
def roc_curve(spark, sf_dir):
    return rounded(V.roc_curve(scored(spark, sf_dir), "label", "score"), {"fpr": 9, "tpr": 9})


@key("roc_on_grid", f"""with {_S},
g as (select fold, score, count_if(label = 1) as pos, count_if(label = 0) as neg from s group by 1, 2),
c as (select fold, sum(neg) over w / sum(neg) over (partition by fold)::double as fpr, sum(pos) over w / sum(pos) over (partition by fold)::double as tpr
      from g window w as (partition by fold order by score desc)),
u as (select fold, fpr, max(tpr) as tpr from c group by 1, 2 union all select distinct fold, -1e-12::double, 0.0::double from s),
e as (select fold, fpr, tpr, lead(fpr) over (partition by fold order by fpr) as x1, lead(tpr) over (partition by fold order by fpr) as y1 from u),
k as (select unnest(range(100))::int as point),
i as (select e.fold, k.point, case when k.point = 0 then 0.0 when x1 is null then tpr
        else tpr + (y1 - tpr) * (k.point / 99.0::double - greatest(fpr, 0)) / (x1 - greatest(fpr, 0)) end as y
      from e join k on fpr <= k.point / 99.0::double and (x1 > k.point / 99.0::double or x1 is null))
select point, round(point / 99.0::double, 9) as fpr, round(avg(y), 9) as mean_tpr from i group by point""")
def roc_on_grid(spark, sf_dir):
    return rounded(V.roc_on_grid(scored(spark, sf_dir), "label", "score", "fold"), 9)


@key("pr_curve", f"""with {_S}, {_C}
select score as threshold, round(tp / (tp + fp)::double, 9) as precision, round(tp / p::double, 9) as recall from c""")
def pr_curve(spark, sf_dir):
    return rounded(V.pr_curve(scored(spark, sf_dir), "label", "score"), {"precision": 9, "recall": 9})


@key("average_precision", f"""with {_S}, {_C}
select round(sum(pos * (tp / (tp + fp)::double)) / any_value(p)::double, 9) as average_precision from c""")
def average_precision(spark, sf_dir):
    return rounded(V.average_precision(scored(spark, sf_dir), "label", "score"), 9)


@key("fold_auc_summary", f"""with {_S},
g as (select fold, score, count_if(label = 1) as pos, count_if(label = 0) as neg from s group by 1, 2),
c as (select fold, pos, neg, sum(neg) over (partition by fold order by score) as below, sum(pos) over (partition by fold) as p,
             sum(neg) over (partition by fold) as n from g),
f as (select fold, sum(pos * (below - 0.5::double * neg)) / any_value(p * n)::double as auc from c group by 1),
o as (select score, count_if(label = 1) as pos, count_if(label = 0) as neg from s group by 1),
a as (select sum(pos * (b - 0.5::double * neg)) / any_value(p * n)::double as auc
      from (select pos, neg, sum(neg) over (order by score) as b, sum(pos) over () as p, sum(neg) over () as n from o))
select round(avg(f.auc), 9) as mean_auc, round(stddev_pop(f.auc), 9) as std_auc, round(any_value(a.auc), 9) as overall_auc from f, a""")
def fold_auc_summary(spark, sf_dir):
    return rounded(V.fold_summary(scored(spark, sf_dir), "label", "score", "fold"), 9)
