"""Sinks: lines to a stream, callbacks on the driver or in tasks, Kafka and AMQP."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.operators.numbering import numbered
from brookline.scratch import Scratch
from brookline.types import ANY, BINARY, KV, KVM, STREAM, Kind


def line(value: Column, kind: Kind) -> Column:
    """One element as a line: bytes as they are, key and value with an arrow between, other types as text."""
    if kind in (BINARY, STREAM):
        return value.cast("string")
    if kind in (KV, KVM):
        return F.concat(F.coalesce(value["key"].cast("string"), F.lit("")), F.lit(" -> "), F.coalesce(value["value"].cast("string"), F.lit("")))
    return value.cast("string")


class Out:
    """Lines in order to a text stream, which is flushed each `each` elements and at the end. Rows come partition by partition, so the driver holds one partition."""

    takes = ANY

    def __init__(self, stream: IO[str] | None = None):
        self.stream = stream or sys.stdout

    def write(self, step, options) -> int:
        df = step.frame().orderBy(*step.keys).select(line(F.col("value"), step.kind).alias("line"))
        n = 0
        for row in df.toLocalIterator(prefetchPartitions=True):
            self.stream.write((row["line"] or "") + "\n")
            n += 1
            if options.each and n % options.each == 0:
                self.stream.flush()
        self.stream.flush()
        return n


class Callback:
    """process(value) for each element in order, flush() each `each` elements and once at the end. Flushing twice must do no harm."""

    def __init__(self, process: Callable[[Any], None], flush: Callable[[], None] = lambda: None, takes: Kind = ANY, close: Callable[[], None] = lambda: None):
        self.process, self.flush, self.takes, self.close = process, flush, takes, close

    def write(self, step, options) -> int:
        n = 0
        try:
            for row in step.frame().orderBy(*step.keys).select("value").toLocalIterator():
                self.process(row["value"])
                n += 1
                if options.each and n % options.each == 0:
                    self.flush()
            self.flush()
        finally:
            self.close()
        return n


class PerTask:
    """A sink with resources in each task: make() gives an object with process(value), flush() and close().

    Elements are in order within a task, and tasks have consecutive ranges of the order; flush() comes
    each `each` elements of a task and at its end. In a stream every micro-batch is written so.
    """

    def __init__(self, make: Callable[[], Any], takes: Kind = ANY):
        self.make, self.takes = make, takes

    def write(self, step, options) -> None:
        make, each = self.make, options.each

        def run(rows: Iterable) -> None:
            sink = make()
            try:
                for n, row in enumerate(rows, 1):
                    sink.process(row["value"])
                    if each and n % each == 0:
                        sink.flush()
                sink.flush()
            finally:
                sink.close()

        step.frame().orderBy(*step.keys).select("value").foreachPartition(run)


class Reporting:
    """A sink in tasks whose flushes count the whole order: make() gives an object with process(value), flush() and close(); what flush() returns is how many elements it flushed.

    Elements are in order within a task, and flush() comes after each `each` elements of the whole order, or once without `each`. Where
    such a stretch lies in more than one task, each flushes its part. write() gives flush_no and n, the parts added up; without `each`
    there is a flush of 0 for no elements. The driver gets none of it. Values are Arrow's: bytes, and dicts for structs. A task that is run again processes its elements again.
    """

    #: Flushes that a task reports at once.
    ROWS = 10_000

    def __init__(self, make: Callable[[], Any], takes: Kind = ANY):
        self.make, self.takes = make, takes

    def write(self, step, options) -> DataFrame:
        make, rows, kinds = self.make, self.ROWS, pa.schema([("flush_no", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            said = lambda done: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done) if done else ([], []))], schema=kinds)
            sink, done = make(), []
            try:
                elements = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                for number, own in groupby(elements, itemgetter(0)):
                    for _, value in own:
                        sink.process(value)
                    done.append((number, sink.flush()))
                    if len(done) == rows:
                        yield said(done)
                        done = []
                yield said(done)
            finally:
                sink.close()

        df = step.frame().select(*step.keys, "value")
        scratch = Scratch(df.sparkSession)
        if options.each:
            df = numbered(df, step.keys, scratch).withColumn("flush_no", F.expr(f"(rn - 1) div {options.each} + 1")).sortWithinPartitions("rn")
        else:
            df = df.orderBy(*step.keys).withColumn("flush_no", F.lit(1).cast("bigint"))
        parts = scratch.keep(df.select("flush_no", "value").mapInArrow(run, "flush_no bigint, n bigint"), "flushes")
        scratch.drop(*(kept for kept, _ in list(scratch.kept.values()) if kept is not parts))
        if options.each:
            return parts.groupBy("flush_no").agg(F.sum("n").alias("n"))
        return parts.agg(F.lit(1).cast("bigint").alias("flush_no"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"))


class KafkaSink:
    """Keys, values and headers to a topic, by Spark's connector (at least once).

    The connector sets no timestamp on what it writes; with `stamp`, an element's time goes into a header of that
    name, in seconds. A stream needs `checkpoint`, and its query is returned, running.
    """

    takes = KVM

    def __init__(self, topic: str, servers: str, options: dict[str, str] | None = None, stamp: str = "", checkpoint: str = ""):
        self.topic, self.options, self.stamp, self.checkpoint = topic, {"kafka.bootstrap.servers": servers, **(options or {})}, stamp, checkpoint

    def rows(self, step) -> DataFrame:
        headers = F.transform(F.map_entries(F.coalesce(F.col("value.headers"), F.create_map().cast("map<string,binary>"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        if self.stamp:
            time = F.struct(F.lit(self.stamp).alias("key"), F.unix_seconds("ts").cast("string").cast("binary").alias("value"))
            headers = F.when(F.col("ts").isNull(), headers).otherwise(F.array_append(F.filter(headers, lambda h: h["key"] != self.stamp), time))
        return step.frame().select(F.col("value.key").alias("key"), F.col("value.value").alias("value"), headers.alias("headers"), F.lit(self.topic).alias("topic"))

    def write(self, step, options) -> Any:
        df = self.rows(step)
        if not df.isStreaming:
            return df.write.format("kafka").options(**self.options).save()
        if not self.checkpoint:
            raise ValueError("a stream to Kafka needs a checkpoint folder")
        return df.writeStream.format("kafka").options(**self.options).option("checkpointLocation", self.checkpoint).start()


class AmqpSink:
    """Persistent messages from each task over a client of its own; a message that the broker doesn't confirm fails the task.

    With `ordered` one task publishes all in order, which is what an order of publication means. In a stream
    (through Step.run) each micro-batch is published so.
    """

    takes = BINARY

    def __init__(self, connect: Callable[[], Any], exchange: str, binding_key: str, ordered: bool = False):
        self.connect, self.exchange, self.key, self.ordered = connect, exchange, binding_key, ordered

    def write(self, step, options) -> None:
        connect, exchange, key = self.connect, self.exchange, self.key

        def publish(rows: Iterable) -> None:
            client = connect()
            for row in rows:
                if not client.publish(exchange, key, bytes(row["value"]), True):
                    raise OSError("the broker did not confirm a message")

        df = step.frame()
        if self.ordered:
            df = df.repartition(1).sortWithinPartitions(*step.keys)
        df.select("value").foreachPartition(publish)
