"""Intermediate tables of one operator in the shared folder, removed as soon as nothing reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geoloom.session import checkpoint_folder


class Workspace:
    """Writes tables under one folder of the shared storage; ``drop`` removes single ones, ``close`` all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        self._keep = [*getattr(self, "_keep", []), table]        # ids stay taken
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(self.paths[id(t)])

    def close(self, result: DataFrame) -> DataFrame:
        """``result`` as a table of its own, with everything else removed."""
        path = f"{self.folder}-result"
        result.write.parquet(path)
        self._remove(self.folder)
        return self.spark.read.schema(result.schema).parquet(path)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
