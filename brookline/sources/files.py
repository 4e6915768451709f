"""Files: a directory's entries, whole contents, and lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from brookline.types import STREAM, STRING, URL


class Directory:
    """The entries of one directory of any file system that Hadoop's clients know, subdirectories too, by name: an element is a URL with its modification time."""

    kind = URL

    def __init__(self, path: str):
        self.path = path.rstrip("/") or "/"

    def frame(self, spark: SparkSession) -> DataFrame:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        entries = sorted((e.getPath().getName(), e.getModificationTime() // 1000) for e in system.listStatus(place))
        rows = [(i, (system.getUri().getScheme(), self.path, name, mod)) for i, (name, mod) in enumerate(entries, 1)]
        return spark.createDataFrame(rows, _parse_datatype_string(f"k0 bigint, value {URL.ddl}")).select("k0", F.current_timestamp().alias("ts"), "value")


class Contents:
    """Whole files of a path or glob on any file system Spark reads, in the order of their paths."""

    kind = STREAM

    def __init__(self, path: str, recursive: bool = False):
        self.path, self.recursive = path, recursive

    def frame(self, spark: SparkSession) -> DataFrame:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).load(self.path)
        return df.select(F.col("path").alias("k0"), F.date_trunc("second", "modificationTime").alias("ts"), F.col("content").alias("value"))


class Lines:
    """Lines of text files, which Spark splits among tasks (gzip files are unpacked): a line feed alone ends a line, empty ones are dropped, carriage returns stay."""

    kind = STRING

    def __init__(self, path: str, streaming: bool = False, files_per_trigger: int = 1):
        self.path, self.streaming, self.files = path, streaming, files_per_trigger

    def frame(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.option("maxFilesPerTrigger", self.files) if self.streaming else spark.read
        df = reader.format("text").option("lineSep", "\n").load(self.path).where(F.octet_length("value") > 0)
        place = F.col("_metadata.file_block_start") if not self.streaming else F.lit(0)
        key = F.struct(F.col("_metadata.file_path").alias("file"), place.alias("block"), F.monotonically_increasing_id().alias("line"))
        return df.select(key.alias("k0"), F.col("_metadata.file_modification_time").alias("ts"), "value")


def read_urls(urls: DataFrame) -> DataFrame:
    """Contents of the files that a column of URLs names (k0, ts, value), read by the workers; a missing file fails the task."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            contents = []
            for u in pdf["value"]:
                at = os.path.join(u["path"], u["name"])
                if u["proto"] == "file":
                    with open(at.removeprefix("file://"), "rb") as f:
                        contents.append(f.read())
                else:
                    from pyarrow.fs import FileSystem

                    system, inside = FileSystem.from_uri(at if "://" in at else f"{u['proto']}://{at}")
                    with system.open_input_stream(inside) as f:
                        contents.append(f.read())
            pdf["value"] = contents
            yield pdf

    kind = urls.schema["k0"].dataType.simpleString()
    return urls.select("k0", "ts", "value").mapInPandas(run, f"k0 {kind}, ts timestamp, value binary")
