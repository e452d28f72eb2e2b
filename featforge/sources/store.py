"""Versioned feature sets: one Parquet folder per version and an append-only catalog of small Parquet files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CATALOG = (
    "name string, version string, saved_at string, description string, tags array<string>, num_rows long, "
    "num_features int, columns array<string>, extra string, path string, deleted boolean"
)


class FeatureStore:
    """The catalog only ever grows by one row per save or delete, so a lost executor cannot corrupt it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._catalog_path = f"{self.root}/_catalog"

    def _filesystem(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _exists(self, path: str) -> bool:
        fs, jpath = self._filesystem(path)
        return bool(fs.exists(jpath))

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], _CATALOG).coalesce(1).write.mode("append").parquet(self._catalog_path)

    def catalog(self) -> DataFrame:
        """Live versions: rows saved after the last delete of their set."""
        if not self._exists(self._catalog_path):
            return self.spark.createDataFrame([], _CATALOG)
        rows = self.spark.read.schema(_CATALOG).parquet(self._catalog_path)
        deleted = rows.where("deleted").groupBy("name").agg(F.max("saved_at").alias("_deleted_at"))
        return (rows.where("not deleted").join(deleted, "name", "left")
                .where("_deleted_at is null or saved_at > _deleted_at").drop("_deleted_at"))

    def save(self, df: DataFrame, name: str, description: str = "", tags: Sequence[str] = (),
             metadata: Mapping | None = None) -> str:
        saved_at = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        version = f"{name}_{saved_at}_{uuid.uuid4().hex[:6]}"
        path = f"{self.root}/{name}/{version}.parquet"
        df.write.parquet(path)
        n_rows = self.spark.read.parquet(path).count()  # answered from the Parquet footers
        self._append((name, version, saved_at, description, list(tags), n_rows, len(df.columns),
                      df.columns, json.dumps(dict(metadata or {})), path, False))
        return version

    def _rows(self, name: str) -> DataFrame:
        return self.catalog().where(F.col("name") == name)

    def load(self, name: str, version: str | None = None) -> DataFrame:
        rows = self._rows(name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.agg(F.max_by("path", F.struct("saved_at", "version")).alias("path")).first()
        if found.path is None:
            raise FileNotFoundError(f"no feature set {name!r}" + (f" with version {version!r}" if version else ""))
        return self.spark.read.parquet(found.path)

    def list(self) -> DataFrame:
        newest = F.struct("saved_at", "version")
        return self.catalog().groupBy("name").agg(
            F.count(F.lit(1)).alias("num_versions"),
            F.max_by("version", newest).alias("latest_version"),
            F.max_by("saved_at", newest).alias("latest_timestamp"),
            F.max_by("num_features", newest).alias("num_features"),
            F.max_by("description", newest).alias("description"),
            F.max_by("tags", newest).alias("tags"),
        )

    def versions(self, name: str) -> DataFrame:
        rows = self._rows(name)
        if rows.isEmpty():
            raise FileNotFoundError(f"no feature set {name!r}")
        return rows.drop("deleted").orderBy(F.desc("saved_at"), F.desc("version"))

    def metadata(self, name: str, version: str | None = None) -> dict:
        rows = self._rows(name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.orderBy(F.desc("saved_at"), F.desc("version")).first()
        if found is None:
            raise FileNotFoundError(f"no feature set {name!r}" + (f" with version {version!r}" if version else ""))
        out = found.asDict()
        out["metadata"] = json.loads(out.pop("extra"))
        return out

    def delete(self, name: str) -> None:
        """Mark the set deleted first, then remove its files: readers never see a version without files."""
        if self._rows(name).isEmpty():
            raise FileNotFoundError(f"no feature set {name!r}")
        now = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        self._append((name, "", now, "", [], 0, 0, [], "{}", "", True))
        fs, jpath = self._filesystem(f"{self.root}/{name}")
        fs.delete(jpath, True)
