"""Scans, sinks and the feature store."""

from pyspark.sql import functions as F

from featforge.operators.rollup import group_agg
from featforge.plans.keys import key, rounded, table
from featforge.session import scratch_path
from featforge.sources.files import (TableSource, load_datasets, read_csv, read_parquet, schema_report, write_csv,
                                     write_parquet)
from featforge.sources.store import FeatureStore

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@key("csv_roundtrip", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::date as o_orderdate, o_orderpriority from orders
""")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    write_csv(orders, path)
    return read_csv(spark, path, schema=orders.schema)


@key("load_all", " union all ".join(f"select '{t}' as table_name, count(*)::bigint as n_rows from {t}" for t in TABLES))
def load_all(spark, sf_dir):
    registry = {t: TableSource(f"{sf_dir}/{t}.parquet") for t in TABLES}
    out = None
    for name, df in load_datasets(spark, registry).items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@key("scan_pruned", "select l_orderkey, l_quantity from lineitem")
def scan_pruned(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@key("partition_sizes", "select count(*)::bigint as n_rows from lineitem")
def partition_sizes(spark, sf_dir):
    parts = (table(spark, sf_dir, "lineitem").groupBy(F.spark_partition_id().alias("part"))
             .agg(F.count(F.lit(1)).alias("n")))
    return parts.agg(F.sum("n").alias("n_rows"))


@key("parquet_roundtrip", "select l_orderkey, l_linenumber, l_extendedprice, l_returnflag from lineitem")
def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "lineitem-parquet")
    write_parquet(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), path)
    return read_parquet(spark, path)


def _customer_features(spark, sf_dir):
    return group_agg(table(spark, sf_dir, "orders", "o_custkey", "o_totalprice"), "o_custkey",
                     {"o_totalprice": ["mean", "max", "size"]}, "O_")


@key("fs_save_load", """
select o_custkey, round(avg(o_totalprice), 6) as "O_o_totalprice_MEAN", round(max(o_totalprice), 6) as "O_o_totalprice_MAX",
       count(*)::bigint as "O_o_totalprice_SIZE"
from orders group by o_custkey""")
def fs_save_load(spark, sf_dir):
    store = FeatureStore(spark, scratch_path(spark, "store"))
    store.save(_customer_features(spark, sf_dir).withColumn("O_o_totalprice_MAX", F.lit(0.0)), "orders_by_customer", "wrong first version")
    store.save(_customer_features(spark, sf_dir), "orders_by_customer", "order totals", ["orders"], {"source": "orders"})
    return rounded(store.load("orders_by_customer"))


@key("fs_list", """
select 'nations' as name, 1::bigint as num_versions, 3::int as num_features
union all select 'orders_by_customer', 2, 4""")
def fs_list(spark, sf_dir):
    store = FeatureStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        store.save(_customer_features(spark, sf_dir), "orders_by_customer")
    store.save(table(spark, sf_dir, "nation"), "nations")
    return store.list().select("name", "num_versions", "num_features")


@key("fs_delete", """
select 'orders_by_customer' as name, 1::bigint as num_versions, count(distinct o_custkey)::bigint as num_rows from orders""")
def fs_delete(spark, sf_dir):
    """Two sets are deleted, one of them is saved again: only its new version is listed."""
    store = FeatureStore(spark, scratch_path(spark, "store"))
    for name in ("orders_by_customer", "orders_by_customer", "other"):
        store.save(_customer_features(spark, sf_dir), name)
    store.delete("orders_by_customer")
    store.delete("other")
    store.save(_customer_features(spark, sf_dir), "orders_by_customer")
    rows = store.versions("orders_by_customer").agg(F.sum("num_rows").alias("num_rows"))
    return store.list().select("name", "num_versions").join(rows.withColumn("name", F.lit("orders_by_customer")), "name")


@key("fs_versions", """
select 'orders_by_customer' as name, count(distinct o_custkey)::bigint as num_rows, 4::int as num_features, n as save_number
from orders, (select unnest([1, 2])::bigint as n) group by n""")
def fs_versions(spark, sf_dir):
    store = FeatureStore(spark, scratch_path(spark, "store"))
    for n in (1, 2):
        store.save(_customer_features(spark, sf_dir), "orders_by_customer", metadata={"save": n})
    return store.versions("orders_by_customer").select(
        "name", "num_rows", "num_features", F.get_json_object("extra", "$.save").cast("long").alias("save_number"))


@key("schema_report", """
select position::int as position, column_name, physical_type, logical_type, tags, (select count(*) from lineitem)::bigint as n_values
from (values (0, 'l_orderkey', 'bigint', 'Integer', 'foreign_key'), (1, 'l_partkey', 'bigint', 'Integer', 'foreign_key'),
    (2, 'l_suppkey', 'bigint', 'Integer', 'foreign_key'), (3, 'l_linenumber', 'int', 'Integer', 'numeric'),
    (4, 'l_quantity', 'double', 'Double', 'numeric'), (5, 'l_extendedprice', 'double', 'Double', 'numeric'),
    (6, 'l_discount', 'double', 'Double', 'numeric'), (7, 'l_tax', 'double', 'Double', 'numeric'),
    (8, 'l_returnflag', 'string', 'Categorical', 'category'), (9, 'l_linestatus', 'string', 'Categorical', 'category'),
    (10, 'l_shipdate', 'timestamp_ntz', 'Datetime', '')) t(position, column_name, physical_type, logical_type, tags)""")
def schema_report_key(spark, sf_dir):
    """The schema of lineitem beside the number of values in each column."""
    from featforge.operators.rollup import per_column
    lines = table(spark, sf_dir, "lineitem")
    filled = per_column(lines, lines.columns, {"n_values": lambda c: f"count({c})"})
    report = schema_report(lines, foreign_keys=["l_orderkey", "l_partkey", "l_suppkey"])
    return report.join(filled, report["column_name"] == filled["column"]).drop("column")
