"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One of our own only in local mode: on a cluster every executor would write to a disk of its own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="brookline-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables of one run: a lost executor costs the tasks it ran, no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.kept = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", {}
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        at = f"{self.base}/{name}-{self.made}"
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.kept[id(out)] = (out, at)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            if entry := self.kept.pop(id(df), None):
                path = jvm.org.apache.hadoop.fs.Path(entry[1])
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark's cleaner see that shuffles of finished steps are unreachable, so that their files go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
