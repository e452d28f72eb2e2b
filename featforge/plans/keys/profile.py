"""Profiling and data quality."""

from pyspark.sql import functions as F

from featforge.operators import correlation as C
from featforge.operators import profile as Q
from featforge.operators.rows import null_sentinel
from featforge.plans.keys import NUDGE, key, rounded, table

_LINES = """(select l_orderkey, nullif(l_quantity, 50) as l_quantity, l_extendedprice, nullif(l_discount, 0) as l_discount,
 nullif(l_returnflag, 'R') as l_returnflag, l_linestatus from lineitem)"""
_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")
_TEXT = ("l_returnflag", "l_linestatus")


def _lines(spark, sf_dir, *columns):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", *_NUMERIC, *_TEXT)
    df = null_sentinel(null_sentinel(df, ["l_quantity"], 50.0), ["l_returnflag"], "R")
    df = null_sentinel(df, ["l_discount"], 0.0)
    return df.select(*columns) if columns else df


def _each(columns, select, source=_LINES):
    return " union all ".join(f"select '{c}' as \"column\", {select.replace('{c}', c)} from {source}" for c in columns)


def _top(c, source=_LINES, what="v"):
    return (f"(select {what} from (select {c} as v, count(*) as n from {source} where {c} is not null group by 1 "
            "order by n desc, v limit 1))")


@key("missing_table", "select * from (" + _each(
    ("l_orderkey", *_NUMERIC, *_TEXT), "count_if({c} is null)::bigint as missing, "
    "round(100.0::double * count_if({c} is null) / count(*), 1) as percent") + ") where missing > 0")
def missing_table(spark, sf_dir):
    return Q.missing_table(_lines(spark, sf_dir))


@key("column_info", _each(("l_orderkey", *_NUMERIC, *_TEXT),
     "case when '{c}' = 'l_orderkey' then 'bigint' when '{c}' in ('l_returnflag', 'l_linestatus') then 'string' else 'double' end "
     "as dtype, count_if({c} is null)::bigint as nulls, round(100.0::double * count_if({c} is null) / count(*), 9) as null_percent, "
     "count(distinct {c})::bigint as n_distinct"))
def column_info(spark, sf_dir):
    return rounded(Q.column_info(_lines(spark, sf_dir)), 9)


@key("describe", _each(_NUMERIC, "count({c})::bigint as \"count\", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, "
     "min({c}) as \"min\", round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, "
     "round(quantile_cont({c}, 0.75), 6) as p75, max({c}) as \"max\""))
def describe(spark, sf_dir):
    return rounded(rounded(Q.describe(_lines(spark, sf_dir, *_NUMERIC)), {"mean": 4, "std": 4}))


@key("box_stats", _each(_NUMERIC, "min({c}) as low, round(quantile_cont({c}, 0.25), 6) as q1, round(median({c}), 6) as median, "
     "round(quantile_cont({c}, 0.75), 6) as q3, max({c}) as high"))
def box_stats(spark, sf_dir):
    return rounded(Q.box_stats(_lines(spark, sf_dir), _NUMERIC))


@key("profile_numeric", _each(_NUMERIC, "round(avg({c}), 4) as mean, round(median({c}), 6) as median, round(stddev_samp({c}), 4) as std, "
     "min({c}) as \"min\", max({c}) as \"max\", count_if({c} is null)::bigint as missing, "
     "round(100.0::double * count_if({c} is null) / count(*), 6) as missing_pct, count_if(isinf({c}))::bigint as infinity_count"))
def profile_numeric(spark, sf_dir):
    return rounded(rounded(Q.profile_numeric(_lines(spark, sf_dir, *_NUMERIC)), {"mean": 4, "std": 4}))


@key("profile_categorical", " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c})::bigint as unique_values, count_if({c} is null)::bigint as missing, "
    f"round(100.0::double * count_if({c} is null) / count(*), 6) as missing_pct, {_top(c)} as most_common, "
    f"{_top(c, what='n')}::bigint as most_common_count from {_LINES}" for c in _TEXT))
def profile_categorical(spark, sf_dir):
    return rounded(Q.profile_categorical(_lines(spark, sf_dir, *_TEXT)))


def _stage(spark, sf_dir, cleaned):
    df = _lines(spark, sf_dir, "l_quantity", "l_returnflag")
    return df.fillna({"l_quantity": 50.0}).withColumn("flag", F.lit("x")).drop("l_returnflag") if cleaned else df


@key("compare_profiles", """
with r as (select nullif(l_quantity, 50) as q, nullif(l_returnflag, 'R') as f, l_quantity as q2 from lineitem),
m as (select '' as "column", 'n_samples' as metric, count(*)::double as before, count(*)::double as after, 'common' as status from r
union all select '', 'n_features', 2, 2, 'common'
union all select '', 'missing_total', count_if(q is null) + count_if(f is null), 0, 'common' from r
union all select 'l_quantity', 'mean', round(avg(q), 4), round(avg(q2), 4), 'common' from r
union all select 'l_quantity', 'std', round(stddev_samp(q), 4), round(stddev_samp(q2), 4), 'common' from r
union all select 'l_quantity', 'missing', count_if(q is null), 0, 'common' from r
union all select 'l_returnflag', 'missing', count_if(f is null), null, 'removed' from r
union all select 'l_returnflag', 'unique_values', count(distinct f), null, 'removed' from r
union all select 'flag', 'missing', null, 0, 'added'
union all select 'flag', 'unique_values', null, 1, 'added')
select "column", metric, before, after, status from m""")
def compare_profiles(spark, sf_dir):
    before = Q.profile(_stage(spark, sf_dir, False), "raw")
    after = Q.profile(_stage(spark, sf_dir, True), "clean")
    return rounded(Q.compare_profiles(before, after).drop("change"), 4)


@key("profile_series", """
select stage, metric, n as value from (
 select 'raw' as stage, 'n_samples' as metric, count(*)::double as n from lineitem union all
 select 'clean', 'n_samples', count(*) from lineitem union all
 select 'raw', 'missing_total', count_if(l_quantity = 50) + count_if(l_returnflag = 'R') from lineitem union all
 select 'clean', 'missing_total', 0)""")
def profile_series(spark, sf_dir):
    series = Q.profile_series([Q.profile(_stage(spark, sf_dir, False), "raw"), Q.profile(_stage(spark, sf_dir, True), "clean")])
    return series.where(F.col("metric").isin("n_samples", "missing_total")).select("stage", "metric", "value")


@key("cardinality_buckets", " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c})::bigint as n_distinct, case when count(distinct {c}) <= 5 then 'low' "
    f"when count(distinct {c}) <= 20 then 'medium' else 'high' end as bucket from part" for c in ("p_name", "p_brand", "p_type")))
def cardinality_buckets(spark, sf_dir):
    return Q.cardinality_buckets(table(spark, sf_dir, "part"))


@key("quality_outliers", """
with b as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
select 'value' as "column", round(q1 - 3 * (q3 - q1), 6) as low, round(q3 + 3 * (q3 - q1), 6) as high,
       count_if(value < q1 - 3 * (q3 - q1) or value > q3 + 3 * (q3 - q1))::bigint as outliers
from events, b group by q1, q3""")
def quality_outliers(spark, sf_dir):
    return rounded(Q.outlier_counts(table(spark, sf_dir, "events", "value")))


@key("quality_low_variance", "select * from (" + _each(
    (*_NUMERIC, "l_tax"), "round(var_samp({c}), 9) as variance", "lineitem") + ") where variance < 0.01")
def quality_low_variance(spark, sf_dir):
    return rounded(Q.low_variance(table(spark, sf_dir, "lineitem", *_NUMERIC, "l_tax")), 9)


@key("quality_report", f"""
with l as (select l_discount, l_quantity, case when l_tax = 0 then 'infinity'::double else l_discount / l_tax end as rate,
                  nullif(l_returnflag, 'R') as l_returnflag from lineitem),
v as (select case when isinf(rate) then null else rate end as f from l),
b as (select quantile_cont(f, 0.25) as q1, quantile_cont(f, 0.75) as q3 from v)
select 'missing_values' as issue, 'l_returnflag' as "column", count_if(l_returnflag is null)::double as value from l
union all select 'categorical_features', 'l_returnflag', count(distinct l_returnflag) from l
union all select 'low_variance', 'l_discount', round(var_samp(l_discount), 9) from l
union all select 'infinity_values', 'rate', count_if(isinf(rate)) from l
union all select 'outliers', 'rate', count_if(rate < q1 - 3 * (q3 - q1) or rate > q3 + 3 * (q3 - q1)) from l, b group by q1, q3""")
def quality_report(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_discount", "l_quantity", "l_tax", "l_returnflag")
    rate = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide("l_discount", "l_tax"))
    df = null_sentinel(df.withColumn("rate", rate).drop("l_tax"), ["l_returnflag"], "R")
    return rounded(Q.quality_report(df), 9)


@key("validate_counts", """
select 'l_quantity' as "column", count_if(l_quantity = 50)::bigint as nulls, 0::bigint as infinities from lineitem
union all select 'rate', 0, count_if(l_tax = 0)::bigint from lineitem
union all select 'l_returnflag', count_if(l_returnflag = 'R')::bigint, 0 from lineitem""")
def validate_counts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_quantity", "l_tax", "l_returnflag")
    rate = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), F.col("l_tax")))
    df = null_sentinel(null_sentinel(df.withColumn("rate", rate), ["l_quantity"], 50.0), ["l_returnflag"], "R")
    return Q.validate_counts(df, ["l_quantity", "rate"], "l_returnflag")


@key("target_distribution", """
select quality, count(*)::bigint as "count", round(100.0::double * count(*) / sum(count(*)) over (), 9) as percent
from documents left join labels using (doc_id) group by 1""")
def target_distribution(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(Q.target_distribution(df, "quality"), 9)


@key("corr_with_target", _each(
    ("l_quantity", "l_discount", "l_orderkey"), "round(corr({c}, l_extendedprice), 8) as corr"))
def corr_with_target(spark, sf_dir):
    df = _lines(spark, sf_dir, "l_quantity", "l_discount", "l_orderkey", "l_extendedprice")
    return rounded(Q.corr_with(df, "l_extendedprice"), 8)


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")


@key("corr_matrix", " union all ".join(
    f"select '{a}' as a, '{b}' as b, " + ("1.0::double" if a == b else f"round(corr({a}, {b}), 8)") + " as corr from "
    + (f"(select count(*) from {_LINES})" if a == b else _LINES) for a in _CORR for b in _CORR))
def corr_matrix(spark, sf_dir):
    return rounded(C.corr_matrix(_lines(spark, sf_dir, *_CORR)), 8)


@key("high_corr_pairs", """
select 'l_extendedprice' as a, 'net' as b, round(corr(p, p * (1 - d)), 7) as corr from (select l_extendedprice as p, l_discount as d from lineitem)
union all select 'l_quantity', 'twice', 1.0 from (select count(*) from lineitem)""")
def high_corr_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount").withColumns(
        {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "twice": F.col("l_quantity") * 2})
    return rounded(C.high_corr_pairs(df, 0.95), 7)


@key("histogram", """
with r as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
b as (select least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from orders, r group by 1)
select i::int as bin, round((lo + i * ((hi - lo) / 20)) * {0}, 4) as low, round((lo + (i + 1) * ((hi - lo) / 20)) * {0}, 4) as high,
       coalesce(n, 0)::bigint as n
from (select unnest(range(20)) as i) cross join r left join b on b.bin = i""".replace("{0}", str(NUDGE)))
def histogram(spark, sf_dir):
    return rounded(Q.histogram(table(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice", 20), 4, nudge=True)


@key("kde_by_class", """
with r as (select c_mktsegment, c_acctbal as v from customer),
s as (select c_mktsegment, count(*) as n, stddev_samp(v) * power(count(*), -0.2::double) as h from r group by 1),
x as (select min(v) as lo, max(v) as hi from r),
g as (select unnest(range(500))::int as point)
select r.c_mktsegment, g.point, round(lo + g.point * ((hi - lo) / 499), 6) as x,
       round(sum(exp(-0.5::double * power((lo + g.point * ((hi - lo) / 499) - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 12) as density
from r join s using (c_mktsegment), x, g group by 1, 2, lo, hi""")
def kde_by_class(spark, sf_dir):
    out = Q.kde(table(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment", bins=None)
    return rounded(rounded(out, {"x": 6}), {"density": 12})


@key("feature_breakdown", """
select 'numeric' as kind, origin, n::int as n, (select count(*) from customer)::int as n_rows
from (values ('generated', 6), ('original', 2)) t(origin, n)""")
def feature_breakdown(spark, sf_dir):
    """Kinds of columns of the depth-1 matrix, beside the number of customers it describes."""
    from featforge.operators.synthesis import dfs
    from featforge.plans.keys.synthesis import entity_set
    matrix = dfs(entity_set(spark, sf_dir, with_lines=False), max_depth=1)
    return Q.feature_breakdown(matrix).withColumn("n_rows", F.lit(matrix.count()))


@key("profile_merged", " union all ".join(f"""
select '{c}' as column, count(*)::bigint as rows, count(*) filter ({c} is null)::bigint as missing, min({c})::double as low, max({c})::double as high,
       true as distinct_held, true as median_held from {_LINES}""" for c in _NUMERIC))
def profile_merged(spark, sf_dir):
    """Profiles of parts of the lines, merged by their sketches, and whether the estimates keep their stated bounds."""
    from featforge.operators import sketches as S
    from featforge.operators.profile import distinct_table
    df = _lines(spark, sf_dir, "l_orderkey", *_NUMERIC)
    parts = S.sketch_profile(df.withColumn("_part", F.col("l_orderkey") % 7), _NUMERIC, ["_part"])
    found = S.read_profiles(S.merge_profiles(parts))
    exact = distinct_table(df, _NUMERIC).withColumnRenamed("n_distinct", "_exact")
    found = found.join(exact, "column")
    medians = {r["column"]: r["median"] for r in found.select("column", "median").collect()}
    share = lambda c, sign: F.avg((F.expr(f"{c} {sign} {medians[c]!r}d")).cast("double"))
    ranks = df.agg(*[share(c, sign).alias(f"{c}{sign}") for c in _NUMERIC for sign in ("<", "<=")]).first()
    held = {c: ranks[f"{c}<"] - S.rank_error() <= 0.5 <= ranks[f"{c}<="] + S.rank_error() for c in _NUMERIC}
    of = F.create_map(*[F.lit(v) for pair in held.items() for v in pair])
    close = F.abs(F.col("n_distinct") / F.col("_exact") - 1) <= S.distinct_error()
    return found.select("column", "rows", "missing", "low", "high", close.alias("distinct_held"), of[F.col("column")].alias("median_held"))
