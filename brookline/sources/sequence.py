"""Sources of items: a list once, or a number of items cycling a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from brookline.types import STRING, Kind

INLINE = 1000


class Items:
    """Each item once, in order."""

    def __init__(self, items: Sequence, kind: Kind = STRING):
        self.items, self.kind = list(items), kind

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, x) for i, x in enumerate(self.items, 1)]
        schema = f"k0 bigint, value {self.kind.ddl}"
        return spark.createDataFrame(rows, _parse_datatype_string(schema)).select("k0", F.current_timestamp().alias("ts"), "value")


class Cycle:
    """Exactly n items, cycling a list; made on the workers, in parallel."""

    def __init__(self, n: int, items: Sequence, kind: Kind = STRING):
        if n > 0 and not items:
            raise ValueError("there is nothing to cycle")
        self.n, self.items, self.kind = n, list(items), kind

    def frame(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.n)
        now = F.current_timestamp().alias("ts")
        if not self.items:
            return ids.select((F.col("id") + 1).alias("k0"), now, F.lit(None).cast(self.kind.ddl).alias("value"))
        at = F.col("id") % len(self.items)
        if len(self.items) <= INLINE and self.kind.ddl in ("string", "bigint", "double", "int"):
            value = F.element_at(F.array(*map(F.lit, self.items)), (at + 1).cast("int")).cast(self.kind.ddl)
            return ids.select((F.col("id") + 1).alias("k0"), now, value.alias("value"))
        table = spark.createDataFrame(list(enumerate(self.items)), _parse_datatype_string(f"at bigint, value {self.kind.ddl}"))
        return ids.withColumn("at", at).join(table, "at").select((F.col("id") + 1).alias("k0"), now, "value")
