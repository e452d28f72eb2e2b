"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> str:
    """Send this package to all executors, for clusters that don't have it installed; returns the file sent.

    Functions that run in Python workers are found there by module name. The driver serves the file to executors.
    """
    import featforge
    root = os.path.dirname(os.path.abspath(featforge.__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("featforge", os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="featforge-ship-"), "featforge.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(target)
    return target


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder, because there driver and executors share one disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="featforge-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of this session have at most ``rows`` rows, so that tasks over whole texts hold less on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > rows:  # 0 is no bound
        spark.conf.set(name, rows)


def same_splits(spark: SparkSession) -> None:
    """Let scans of this session split files alike, also when executors come or go between two of them."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, max(1, spark.sparkContext.defaultParallelism))


def cut_lineage(df: DataFrame, spread: bool = False) -> DataFrame:
    """Materialise ``df`` reliably, so later passes see the same rows in the same partitions.

    ``spread`` is for data that is read many times: when it has fewer partitions than the cluster has cores, it is
    redistributed once.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if spread and out.rdd.getNumPartitions() < cores:
        out = out.repartition(cores).checkpoint(eager=True)
    return out
