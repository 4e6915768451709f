"""Running flows over streams: all steps of a flow, folds with state of Spark's, timed counts and flushes.

State and offsets are in the query's checkpoint, so a restart neither loses nor repeats a batch's
fold. Order within a micro-batch is that of the keys.
"""

from __future__ import annotations

import base64
import threading
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from brookline.types import LONG, Kind


class _Carried:
    """What a flow's folds and limits carry, written for each micro-batch beside the offsets."""

    def __init__(self, steps: list, checkpoint: str):
        self.steps, self.at = steps, f"{checkpoint.rstrip('/')}/carried"
        self.spark = steps[0].flow.spark
        self.batch = -1

    def load(self, batch: int) -> None:
        """What the batch before this one left; a batch that is run again begins where it began before."""
        own: list[dict] = [{} for _ in self.steps]
        if batch > 0:
            text = self.spark.read.text(f"{self.at}/{batch - 1}").first()[0]
            own = cloudpickle.loads(base64.b64decode(text))
        for step, carry in zip(self.steps, own):
            step.carry = carry

    def save(self, batch: int) -> None:
        text = base64.b64encode(cloudpickle.dumps([s.carry for s in self.steps])).decode()
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.at}/{batch}")
        self.batch = batch

    def full(self) -> bool:
        return any(s.options.limit and s.carry is not None and s.carry.get("passed", 0) >= s.options.limit for s in self.steps)


def run(step, process: Callable[[DataFrame], None], checkpoint: str, once: bool = False, seconds: float = 0.2) -> StreamingQuery:
    """Run a flow over a stream; process() gets what each micro-batch brings (k0 and other keys, ts, value).

    A micro-batch goes through the flow's own steps, so large ones are folded in parallel as any batch is;
    folds and limits go on from what the batch before carried, and a flow whose limit is reached
    stops its source. With every() the batches come at that interval and a fold emits at each. With `once` the
    run takes what is there, and returns when all of it is done and the rest of each fold has been
    emitted; otherwise finish() of the returned query does that. A batch that was interrupted is run again from
    the same state, so process() should be able to repeat it.
    """
    steps = step.chain()
    ticks = [s.options.every for s in steps if s.options.every]
    carried, stream = _Carried(steps, checkpoint), steps[0]._build(steps[0].options)
    if not stream.isStreaming:
        raise ValueError("this flow's source is no stream")

    def batch(part: DataFrame, number: int) -> None:
        carried.load(number)
        if not carried.full():
            steps[0].fed = None
            held = _Held(part, steps[0])
            with held:
                out = step.flow.scratch.keep(step.frame(), "batch")
            if out.limit(1).count():
                process(out)
            step.flow.scratch.drop(out)
        carried.save(number)
        if carried.full() and not once:  # from another thread: a query can't be stopped within its own batch
            threading.Thread(target=lambda: running[0].stop(), daemon=True).start()

    running: list[StreamingQuery] = []
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(min(ticks or [seconds]) * 1000)} milliseconds")
    query = writer.start()
    running.append(query)

    def finish(timeout: float | None = None) -> None:
        """Stop, and emit what folds have not emitted yet."""
        if once:
            query.awaitTermination(timeout)
        elif query.isActive:
            query.processAllAvailable()
        query.stop()
        if query.exception():
            raise query.exception()
        _finish(step, steps, process)

    query.finish = finish
    query.reached = carried.full
    if once:
        finish()
    return query


class _Held:
    """While a micro-batch is built, its frame stands for the root's; a limit of the root's own counts too."""

    def __init__(self, part: DataFrame, root):
        self.part, self.root = part, root

    def __enter__(self) -> None:
        self.build, self.root._build = self.root._build, lambda _: self.part

    def __exit__(self, *_: object) -> None:
        self.root._build = self.build


def _finish(step, steps: list, process: Callable[[DataFrame], None]) -> None:
    from brookline.operators.flow import rest_of

    for fold in (s for s in steps if s.role == "fold" and s.carry and s.carry.get("due")):
        fold.carry["due"] = False
        rest = dict(fold.carry, emitted=fold.carry["emitted"] + 1)
        fold.fed = rest_of(fold.up.fed if fold.up.fed is not None else _shape(fold.up), fold.up.keys, fold.kind, rest, True)
        try:
            out = step.flow.scratch.keep(step.frame(), "rest")
            if out.limit(1).count():
                process(out)
        finally:
            fold.fed = None


def _shape(step) -> DataFrame:
    """An empty frame with the columns that a step has."""
    root = step.chain()[0]
    with _Held(root.flow.spark.createDataFrame([], root._build(root.options).schema), root):
        carries = [(s, s.carry) for s in step.chain()]
        for s, _ in carries:
            s.carry = None
        try:
            return step.frame()
        finally:
            for s, c in carries:
                s.carry = c


def fold_each(df: DataFrame, key: str, fn: Callable[[Any, Any], Any], init: Any, each: int, gives: Kind = LONG) -> DataFrame:
    """emit_no, value: a running fold over a stream, emitted at each `each` elements. A global fold is one state, so it is one task by nature."""
    kind = df.schema[key].dataType.simpleString()

    def run(_: tuple, batches, state):
        acc, n = state.get if state.exists else (init, 0)
        acc, n = (acc, int(n))
        rows = pd.concat(list(batches)).sort_values(key)
        out = []
        for x in rows["value"]:
            acc, n = fn(acc, x), n + 1
            if n % each == 0:
                out.append((n // each, acc))
        state.update((acc, n))
        yield pd.DataFrame(out, columns=["emit_no", "value"])

    one = df.select(F.col(key).cast(kind), "value").withColumn("g", F.lit(1))
    return one.groupBy("g").applyInPandasWithState(run, f"emit_no bigint, value {gives.ddl}", f"acc {gives.ddl}, n bigint", "append", "NoTimeout")


def count_every(df: DataFrame, seconds: float, name: str, once: bool = False, checkpoint: str = "") -> StreamingQuery:
    """A count of all elements so far, at each tick, in a table of the driver's; partial counts are combined map-side."""
    writer = df.groupBy().agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")
    return writer.start()


def flush_each(df: DataFrame, process: Callable[[DataFrame], None], seconds: float, checkpoint: str) -> StreamingQuery:
    """A timed sink: process() gets what came since the last tick; empty ticks are left out."""

    def batch(part: DataFrame, _: int) -> None:
        if not part.isEmpty():
            process(part)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def watermark_offsets(query: StreamingQuery) -> list:
    """What a query has committed so far: the end offsets of its sources."""
    progress = query.lastProgress
    return [s["endOffset"] for s in progress["sources"]] if progress else []


__all__ = ["Column", "count_every", "flush_each", "fold_each", "run", "watermark_offsets"]
