"""Python workers find the package when only the driver has it on its path."""

import os
import shutil
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.driver.memory", "1g").getOrCreate())
from featforge.operators.correlation import corr_pairs
from featforge.session import ship_package
ship_package(spark)
df = spark.range(100).selectExpr("cast(id as double) as a", "cast(id * 2 as double) as b", "cast(id % 7 as double) as c")
rows = corr_pairs(df, ["a", "b", "c"]).collect()
assert len(rows) == 3, rows
print("SHIPPED")
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SHIPPED" in out.stdout, out.stderr[-2000:]


ENTRY = """
import __spark_entry__ as entry
queries, sql = entry.queries(), entry.oracle_sql()
assert "dfs_depth2" in queries and set(sql) <= set(queries), sorted(set(sql) - set(queries))
print("KEYS", sum(k.startswith("op") or k == "pipeline" for k in [*queries, *sql]))
"""


def test_entry_without_the_document_operators(tmp_path):
    """On copies of the library: with those folders, without them, and without the pipeline too."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = os.path.isdir(os.path.join(repo, "featforge", "llm"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for name, left_out in (("whole", ()), ("without", ("llm",)), ("bare", ("llm", "corpus_pipeline.py"))):
        copy = tmp_path / name
        copy.mkdir()
        for item in ("__spark_entry__.py", "corpus_pipeline.py", "featforge"):
            source = os.path.join(repo, item)
            if os.path.isdir(source):
                shutil.copytree(source, copy / item, ignore=shutil.ignore_patterns("__pycache__", *left_out))
            elif item not in left_out and os.path.exists(source):
                shutil.copy(source, copy / item)
        out = subprocess.run([sys.executable, "-c", ENTRY], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
        assert "KEYS" in out.stdout, out.stderr[-2000:]
        assert (int(out.stdout.split()[-1]) > 0) == (name == "whole" and there)
