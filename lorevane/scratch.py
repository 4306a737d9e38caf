"""Intermediate tables that survive the loss of an executor.

Tables are written below the folder in ``spark.checkpoint.dir``, which a cluster shares
between its machines. Only a session that names none, as in tests, gets one here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Shuffle files of a write that has ended are of no use: its table is what later steps read.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The shared folder; where none is set: a temporary one for a local master, else one in the warehouse."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="lorevane-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """Writes tables for one query; ``drop`` removes those that no later step reads, and the rest goes with the driver."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{root(spark)}/lorevane/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        p = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows once as Parquet and return a frame that reads them."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if path := self.paths.pop(id(f), None):
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
