"""Projections, filters and row-wise expressions."""

from pyspark.sql import functions as F

from featforge.functions.numeric import positive_part, row_max, row_mean, row_null_count, to_int_trunc
from featforge.operators import rows as R
from featforge.operators.ordered import add_row_index
from featforge.operators.rollup import per_column
from featforge.plans.keys import key, rounded, table


@key("ratio_columns", """
select l_orderkey, l_linenumber, l_extendedprice, l_extendedprice / nullif(l_quantity, 0) as unit_price,
       l_discount / nullif(l_tax, 0) as discount_tax
from lineitem""")
def ratio_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    out = R.add_ratios(df, {"unit_price": ("l_extendedprice", "l_quantity"), "discount_tax": ("l_discount", "l_tax")})
    return out.drop("l_quantity", "l_discount", "l_tax")


@key("diff_columns", """
select l_orderkey, l_linenumber, l_extendedprice, round(l_discount - l_tax, 6) as margin from lineitem""")
def diff_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return rounded(R.add_diffs(df, {"margin": ("l_discount", "l_tax")}).drop("l_discount", "l_tax"))


@key("null_sentinel", """
select l_orderkey, nullif(l_linenumber, 7) as l_linenumber, nullif(l_quantity, 50.0) as l_quantity from lineitem""")
def null_sentinel(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return R.null_sentinel(R.null_sentinel(df, ["l_linenumber"], 7), ["l_quantity"], 50.0)


@key("filter_null_safe", """
select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders
where nullif(o_orderstatus, 'P') is distinct from 'F'""")
def filter_null_safe(spark, sf_dir):
    df = R.null_sentinel(table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), ["o_orderstatus"], "P")
    return R.filter_not_equal(df, "o_orderstatus", "F")


@key("filter_threshold", """
select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R' and l_discount > 0.05""")
def filter_threshold(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.where("l_returnflag = 'R' and l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_extendedprice")


@key("split_labelled", """
select d.doc_id, d.lang, l.quality, case when l.quality is null then 'unlabelled' else 'labelled' end as part
from documents d left join labels l using (doc_id)""")
def split_labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang").join(
        table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    known, unknown = R.split_by_label(docs, "quality")
    return known.withColumn("part", F.lit("labelled")).unionByName(unknown.withColumn("part", F.lit("unlabelled")))


@key("drop_columns", "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def drop_columns(spark, sf_dir):
    return R.drop_columns(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate"])


@key("drop_sparse", """
select l_orderkey, nullif(l_returnflag, 'R') as l_returnflag from lineitem""")
def drop_sparse(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber")
    sparse = F.when(F.col("l_linenumber") == 7, 1)  # null for about six of seven rows
    return R.drop_sparse(R.null_sentinel(df, ["l_returnflag"], "R").withColumn("l_linenumber", sparse))


@key("drop_all_null", "select o_orderkey, o_totalprice from orders")
def drop_all_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return R.drop_all_null(df.withColumn("empty", F.when(F.col("o_totalprice") < 0, 1)))


@key("sanitize_names", """
select l_orderkey as "SUM_l_orderkey_", l_tax as f1_tax, l_discount as l_a_b_, l_quantity as "l_a_b__1" from lineitem""")
def sanitize_names(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_tax", "l_discount", "l_quantity")
    return R.sanitize_names(df.toDF("SUM(l_orderkey)", " 1:tax", "l{a,b}", "l[a.b]"), "strict")[0]


@key("row_mean_max", """
select l_orderkey, l_linenumber, l_extendedprice,
       round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int
             + (c is not null)::int, 0), 6) as row_mean,
       round(greatest(a, b, c), 6) as row_max
from (select *, nullif(l_discount, 0) as a, nullif(l_tax, 0) as b, nullif(l_quantity, 1) / 100 as c from lineitem)""")
def row_mean_max(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    df = df.withColumns({"a": F.nullif("l_discount", F.lit(0.0)), "b": F.nullif("l_tax", F.lit(0.0)),
                         "c": F.nullif("l_quantity", F.lit(1.0)) / 100})
    return rounded(df.select("l_orderkey", "l_linenumber", "l_extendedprice", row_mean(["a", "b", "c"]).alias("row_mean"),
                             row_max(["a", "b", "c"]).alias("row_max")))


@key("row_null_count", """
select l_orderkey, l_linenumber, ((nullif(l_discount, 0) is null)::int + (nullif(l_tax, 0) is null)::int)::int as nulls
from lineitem""")
def row_nulls(spark, sf_dir):
    df = R.null_sentinel(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax"),
                         ["l_discount", "l_tax"], 0.0)
    return df.select("l_orderkey", "l_linenumber", row_null_count(["l_discount", "l_tax"]).alias("nulls"))


@key("positive_part", """
select l_orderkey, l_linenumber,
       case when (nullif(l_linenumber, 7) - l_quantity) > 0 then nullif(l_linenumber, 7) - l_quantity else 0 end as above
from lineitem""")
def positive(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    gap = F.nullif("l_linenumber", F.lit(7)) - F.col("l_quantity")
    return df.select("l_orderkey", "l_linenumber", positive_part(gap).alias("above"))


@key("clean_infinite", """
select l_orderkey, l_linenumber, round(case when l_tax = 0 then null else l_discount / l_tax end, 6) as to_null,
       round(case when l_tax = 0 then 0 else l_discount / l_tax end, 6) as to_zero
from lineitem""")
def clean_infinite(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    quotient = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide("l_discount", "l_tax"))
    df = df.select("l_orderkey", "l_linenumber", quotient.alias("to_null"), quotient.alias("to_zero"))
    return rounded(R.clean_infinite(R.clean_infinite(df, "null", ["to_null"]), "zero", ["to_zero"]))


@key("age_trunc", "select c_custkey, trunc(c_acctbal / -365)::int as age_int from customer")
def age_trunc(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", to_int_trunc(F.col("c_acctbal") / -365).alias("age_int"))


@key("coerce_numeric", """
select o_orderkey, coalesce(trunc(try_cast(split_part(o_orderpriority, '-', 1) as double)), 0)::bigint as priority,
       0::bigint as status from orders""")
def coerce_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority"),
        F.col("o_orderstatus").alias("status"))
    return R.coerce_numeric(df, ["priority", "status"], fill=0, dtype="long")


@key("row_index", """
select l_orderkey, l_linenumber, l_extendedprice, row_number() over (order by l_orderkey, l_linenumber, l_extendedprice,
       l_partkey, l_suppkey, l_quantity, l_shipdate)::bigint as row_index
from lineitem""")
def row_index(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    return add_row_index(table(spark, sf_dir, "lineitem", *order), order, "row_index").select(*order[:3], "row_index")


@key("dedupe_columns", "select c_custkey, c_name, c_acctbal from customer")
def dedupe_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return R.dedupe_columns(df.select("c_custkey", "c_name", F.col("c_acctbal"), F.col("c_name"), F.lit(0).alias("c_custkey")))


@key("downcast", " union all ".join(f"""
select '{c}' as column_name, case when min({c}) > -128 and max({c}) < 127 then 'tinyint'
       when min({c}) > -32768 and max({c}) < 32767 then 'smallint'
       when min({c}) > -2147483648 and max({c}) < 2147483647 then 'int' else 'bigint' end as physical_type,
       sum({c})::bigint as total
from lineitem""" for c in ("l_orderkey", "l_suppkey", "l_linenumber")))
def downcast(spark, sf_dir):
    small, report = R.downcast(table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber"))
    totals = per_column(small, small.columns, {
        "physical_type": lambda c: f"first('{report['types'][c.strip('`')]}')", "total": lambda c: f"cast(sum({c}) as bigint)"})
    return totals.withColumnRenamed("column", "column_name")


@key("align_schema", """
select o_totalprice, o_orderkey, 0::double as absent_number, 'MISSING' as absent_text from orders""")
def align_schema(spark, sf_dir):
    from pyspark.sql import types as T
    fitted = T.StructType([T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderkey", T.LongType()),
                           T.StructField("absent_number", T.DoubleType()), T.StructField("absent_text", T.StringType())])
    return R.align_to(table(spark, sf_dir, "orders"), fitted)


@key("stringify", """
select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderstatus from orders""")
def stringify(spark, sf_dir):
    return R.stringify(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"))


@key("fill_const", """
select l_orderkey, coalesce(nullif(l_linenumber, 7), 0) as l_linenumber, coalesce(nullif(l_quantity, 50), 0) as l_quantity
from lineitem""")
def fill_const(spark, sf_dir):
    return R.fill_const(null_sentinel(spark, sf_dir))


