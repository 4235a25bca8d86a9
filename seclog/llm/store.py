"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seclog.storage import checkpoint_dir


class Scratch:
    """Tables of one operator call. A written table cuts lineage and outlives its writers.

    ``drop`` deletes a table as soon as nothing reads it any more; tables that the result
    still reads stay for the caller.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = "%s/llm-%s-%s" % (checkpoint_dir(spark).rstrip("/"), name, uuid.uuid4().hex)
        self._paths: dict[str, str] = {}
        self._count = 0

    def path(self, name: str) -> str:
        """A new place for a table."""
        self._count += 1
        self._paths[name] = path = "%s/%02d-%s" % (self.base, self._count, name)
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
