"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stash:
    """Results written as Parquet and read again, so that a lost executor costs no lineage and plans stay small."""

    def __init__(self, spark: SparkSession, batch_rows: int | None = None):
        """batch_rows: at most so many rows in an Arrow batch of the steps that are written here, where rows are wide."""
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", {}
        self.settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {})

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; the shuffle files behind it are removed as soon as it is."""
        path = f"{self.root}/{name}-{len(self.paths)}"
        self._write(lambda: df.write.parquet(path))
        return self._kept(self.spark.read.schema(df.schema).parquet(path), path)

    def put_by(self, df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
        """df, written in `parts` buckets of the key, so that joins and groupings on the key alone don't shuffle it again."""
        path, table = f"{self.root}/{name}-{len(self.paths)}", f"stash_{uuid.uuid4().hex}"
        self._write(lambda: df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(table, format="parquet"))
        out = self.spark.table(table)
        out.schema  # resolved here; the name is needed no longer, and the files of an external table stay
        self.spark.sql(f"DROP TABLE {table}")
        return self._kept(out, path)

    def _write(self, write: Callable[[], None]) -> None:
        before = {k: self.spark.conf.get(k) for k in self.settings}
        try:
            for k, v in self.settings.items():
                self.spark.conf.set(k, v)
            write()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _kept(self, out: DataFrame, path: str) -> DataFrame:
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove what no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if id(df) in self.paths:
                path = jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
                path.getFileSystem(conf).delete(path, True)
