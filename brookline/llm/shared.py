"""Reading tables, choosing labelled documents; what cuts lineage comes from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.scratch import Scratch, shared_dir


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, which both the JVM and the worker hold, unless the session says other than Spark's 64."""
    if spark.conf.get(BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH, str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL = 1 << 20


def small(ids: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table of narrow rows, marked for a broadcast if it has few enough; otherwise a join with it shuffles."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a number's text, modulo; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """At most per_class labelled documents of each class: those with the smallest hashes of their ids.

    The bound is a parameter of the fit. Of the labels only the chosen ones (two top-k plans, no
    global sort) meet the documents, as a broadcast of at most 2 * per_class ids. A document
    without text, or with a null label, teaches nothing and is left out; of repeated labels of one
    document the larger counts.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    rank = F.xxhash64("doc_id")
    picked = [own.where(F.col("label") == k).orderBy(rank, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id")

__all__ = ["Scratch", "bounded", "labelled", "remainder", "shared_dir", "small", "table"]
