"""Dense numbering and triggered running folds, without a window over one partition.

A global order is a range partitioning: rows are numbered within their range, ranges are
counted, and each range starts after those before it. Only the counts, a row for each range, meet
in one task. The range of a row is written down with it, since a recomputed partitioning may
sample other bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookline.scratch import Scratch

#: Emissions that one task folds.
STRETCH = 1 << 16

def numbered(df: DataFrame, keys: Sequence[str], scratch: Scratch | None = None, name: str = "rn") -> DataFrame:
    """The rows with their place, from 1, in the order of the keys (which should be unique; ties get any order)."""
    scratch = scratch or Scratch(df.sparkSession)
    parts = max(2, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The number within a partition: ids count up from partition_id << 33.
    held = scratch.keep(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)
    count = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = count.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.col("_id") - F.shiftleft(F.col("_part"), 33) + F.col("_before") + 1
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place.cast("bigint")).drop("_part", "_id", "_before")


def running(df: DataFrame, keys: Sequence[str], each: int, partial: Column, combine: str, init: int | float, by: str = "rn", scratch: Scratch | None = None) -> DataFrame:
    """emit_no, uniq (the last key folded), acc: a cumulative fold of `partial` (sum, max or min) emitted at each `each` rows and at the end.

    Rows are aggregated by bucket, map-side first. Emissions are folded in stretches of STRETCH, each
    in a task of its own; only one row for each stretch meets in the window that has no partition.
    """
    aggregate = {"sum": F.sum, "max": F.max, "min": F.min}[combine]
    both = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}[combine]
    bucket = df.withColumn("emit_no", F.ceil(F.col(by) / each).cast("bigint")).groupBy("emit_no").agg(aggregate(partial).alias("part"), F.max(keys[0]).alias("uniq"), F.max("ts").alias("ts"))
    stretch = F.floor((F.col("emit_no") - 1) / STRETCH)
    bucket = bucket.withColumn("_stretch", stretch)
    within = Window.partitionBy("_stretch").orderBy("emit_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = bucket.groupBy("_stretch").agg(aggregate("part").alias("_whole"))
    before = whole.select("_stretch", aggregate("_whole").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = aggregate("part").over(within)
    total = F.when(F.col("_before").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_before")).otherwise(both(F.col("_own"), F.col("_before")))
    acc = both(total, F.lit(init)) if init is not None else total
    return bucket.withColumn("_own", own).join(F.broadcast(before), "_stretch").select("emit_no", "uniq", "ts", acc.alias("acc"))
