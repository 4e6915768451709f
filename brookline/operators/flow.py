"""Typed, linear flows over DataFrames.

A Flow starts steps from sources. A Step is lazy: it has a kind (the type of its elements), order
keys, options, and a recipe for its DataFrame, whose columns are the keys, `ts` and `value`.
Functions on columns (Column -> Column) stay inside Catalyst; functions with type hints on Python
values run in Arrow batches. Where the kinds of neighbours differ, the registry's shortest
chain of codecs goes between. Ordering is paid for only where a result depends on it: limits,
triggered folds and ordered merges.

Options. par: how many tasks at most run a step's Python function at once (functions on columns are
fused with what is before them, and run wherever that does). buffer: of a source that can be held
back, how many elements a trigger takes; of a step, how many its Python function gets at once.
throttle: elements pass at that rate, through one task. each and every: when folds emit and sinks
flush; a bounded input has no clock, so every() counts only in a stream. limit: the first elements in order.

A flow over a stream is run by Step.run, micro-batch by micro-batch, with the same steps; folds and limits
carry their state from one to the next.

Mistakes of declaration raise at once: TypeError for functions and types, ValueError for options.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, get_type_hints

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.functions.registry import DEFAULT, Codec, path
from brookline.operators.numbering import numbered, running
from brookline.scratch import Scratch
from brookline.types import ANY, BINARY, DOUBLE, LONG, PYTHON, Kind, assignable

SINGLE = ("root", "exchange", "fold")


@dataclass
class Options:
    par: int = 1
    buffer: int = 32
    each: int = 0
    every: float = 0.0
    limit: int = 0
    throttle: float = 0.0
    #: Whether a buffer was asked for; the default holds nothing back.
    bounded: bool = False


class Fold:
    """An aggregation: combine is sum, max or min (which have an exact parallel form), of a column function."""

    def __init__(self, combine: str, of: Callable[[Column], Column], init: Any = 0, gives: Kind = LONG, takes: Kind = ANY):
        if combine not in ("sum", "max", "min"):
            raise ValueError(f"no parallel form of {combine!r}; give fold a Python function instead")
        self.combine, self.of, self.init, self.gives, self.takes = combine, of, init, gives, takes


class Mapper:
    """A map with resources of its own: prepare() runs once a task and returns the function."""

    takes: Kind = ANY
    gives: Kind = ANY

    def prepare(self) -> Callable[[Any], Any]:
        raise NotImplementedError


def signature(fn: Callable, arguments: int, returns: bool = True) -> tuple[list[Kind], Kind | None]:
    """Kinds of an annotated function's arguments and result; TypeError if it isn't one."""
    names = list(inspect.signature(fn).parameters)
    if len(names) != arguments:
        raise TypeError(f"a function of {arguments} argument(s) is wanted, not {len(names)}")
    hints = get_type_hints(fn)
    kinds = []
    for n in names:
        hint = hints.get(n, Any)
        if hint is not Any and hint not in PYTHON:
            raise TypeError(f"{n}: {hint} is no type of elements")
        kinds.append(ANY if hint is Any else PYTHON[hint])
    result = hints.get("return")
    if returns and result not in PYTHON:
        raise TypeError("the result needs a type hint of an element type")
    return kinds, PYTHON.get(result)


def on_values(fn: Callable) -> bool:
    """Whether a callable has hints on Python values, and so isn't a function on columns."""
    try:
        hints = get_type_hints(fn)
    except (TypeError, NameError):
        return False
    return any(h in PYTHON for h in hints.values()) or "Iterator" in str(hints.get("return", ""))


class Flow:
    def __init__(self, spark: SparkSession, codecs: Sequence[Codec] = DEFAULT, par: int = 1):
        self.spark, self.codecs, self.par, self.scratch = spark, codecs, par, Scratch(spark)

    def source(self, source) -> Step:
        """source: has kind and frame(spark) with columns k0, ts, value (batch or streaming)."""

        def build(o: Options) -> DataFrame:
            held = source.admit(o.buffer) if o.bounded and hasattr(source, "admit") else source
            return held.frame(self.spark)

        return Step(self, "root", source.kind, ["k0"], build)

    def table(self, df: DataFrame, key: str, value: Column | str, kind: Kind, ts: Column | None = None) -> Step:
        """A DataFrame as a root: a natural order key, so none has to be made."""
        ts = F.lit(None).cast("timestamp") if ts is None else ts
        v = F.col(value) if isinstance(value, str) else value
        return Step(self, "root", kind, ["k0"], lambda _: df.select(F.col(key).alias("k0"), ts.alias("ts"), v.alias("value")))


class Step:
    def __init__(self, flow: Flow, role: str, kind: Kind, keys: list[str], build: Callable[[Options], DataFrame], up: Step | None = None):
        self.flow, self.role, self.kind, self.keys, self._build, self.up, self.options = flow, role, kind, keys, build, up, Options()
        #: While a stream runs: a frame that stands for this step's, and what it carries from batch to batch.
        self.fed: DataFrame | None = None
        self.carry: dict | None = None
        if up is not None:
            up._validate()

    def _validate(self) -> None:
        """What must hold of a step that another one follows."""
        if self.role in SINGLE and self.options.par > 1:
            raise ValueError(f"a step of kind {self.role} can't have parallelism")
        if self.role == "fold" and not (self.options.each or self.options.every):
            raise ValueError("a fold that another step follows needs a trigger")

    # Options.

    def par(self, n: int) -> Step:
        self.options.par = n
        return self

    def buffer(self, n: int) -> Step:
        if n < 1:
            raise ValueError("a buffer holds one element at least")
        self.options.buffer, self.options.bounded = n, True
        return self

    def each(self, n: int) -> Step:
        self.options.each = n
        return self

    def every(self, seconds: float) -> Step:
        self.options.every = seconds
        return self

    def limit(self, n: int) -> Step:
        """The first n results in order; 0 is no limit."""
        if n < 0:
            raise ValueError("a limit can't be negative")
        self.options.limit = n
        return self

    def throttle(self, count: int, seconds: float) -> Step:
        """At most `count` elements pass in `seconds`; what passes stays the same."""
        if count < 1 or seconds < 0:
            raise ValueError("a rate must be positive")
        self.options.throttle = seconds / count
        return self

    # What the step gives.

    def frame(self) -> DataFrame:
        if self.fed is not None:
            return self.fed
        df = self._build(self.options)
        if self.options.limit:
            if df.isStreaming:
                raise ValueError("a limit on a stream is kept while it runs: see Step.run")
            left = self.options.limit
            if self.carry is not None:
                left = max(0, left - self.carry.get("passed", 0))
            df = df.orderBy(*self.keys).limit(left)
            if self.carry is not None:
                df = self.flow.scratch.keep(df, "limited")
                self.carry["passed"] = self.carry.get("passed", 0) + df.count()
        return _paced(df, self.options.throttle) if self.options.throttle else df

    def chain(self) -> list[Step]:
        """The steps from the root to this one."""
        return [*(self.up.chain() if self.up else ()), self]

    def run(self, process: Callable[[DataFrame], None], checkpoint: str, once: bool = False, seconds: float = 0.2):
        """Run a flow over a stream: see brookline.streaming.runner.run."""
        from brookline.streaming.runner import run

        return run(self, process, checkpoint, once, seconds)

    def ordered(self) -> DataFrame:
        return self.frame().orderBy(*self.keys)

    def values(self, **columns: Column | str) -> DataFrame:
        """Chosen columns of the frame, for queries."""
        df = self.frame()
        return df.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))

    # Steps.

    def _next(self, role: str, kind: Kind, build: Callable[[DataFrame, Options], DataFrame], keys: list[str] | None = None) -> Step:
        return Step(self.flow, role, kind, keys or self.keys, lambda options: build(self.frame(), options), self)

    def code(self, wanted: Kind) -> Step:
        """This step, or one after the codecs that lead to the wanted kind."""
        if assignable(self.kind, wanted):
            return self
        step = self
        for codec in path(self.kind, wanted, self.flow.codecs):
            step = step._next("map", codec.gives, _apply(codec.apply)).par(self.flow.par)
        return step

    def encode(self, codec: Codec) -> Step:
        """An explicit codec, such as gzip's or Avro's, which are never put in by themselves."""
        return self.code(codec.takes)._next("map", codec.gives, _apply(codec.apply))

    def map(self, fn: Callable | Mapper, takes: Kind | None = None, gives: Kind | None = None) -> Step:
        if isinstance(fn, Mapper):
            return self.code(fn.takes)._next("map", fn.gives, _apply(_prepared(fn), python=True))
        if on_values(fn):
            (own,), result = signature(fn, 1)
            return self.code(own)._next("map", result, _apply(_vectorised(fn, result), python=True))
        _columns(fn, 1)
        up = self if takes is None else self.code(takes)
        return up._next("map", gives or up.kind, _apply(fn))

    def filter(self, fn: Callable | Mapper, takes: Kind | None = None) -> Step:
        """What the predicate holds for; a null predicate drops the element. A Mapper that gives booleans is a predicate with resources of its own."""
        if isinstance(fn, Mapper):
            if fn.gives.ddl != "boolean":
                raise TypeError("a filter's function returns bool")
            test = _prepared(fn)
            up = self.code(fn.takes)
            return up._next("filter", up.kind, lambda df, o: _tasks(df, o).where(test(F.col("value"))))
        python = on_values(fn)
        if python:
            (own,), result = signature(fn, 1)
            if result.ddl != "boolean":
                raise TypeError("a filter's function returns bool")
            test, up = _vectorised(fn, result), self.code(own)
        else:
            _columns(fn, 1)
            test, up = fn, self if takes is None else self.code(takes)
        return up._next("filter", up.kind, lambda df, o: (_tasks(df, o) if python else df).where(test(F.col("value"))))

    def flat_map(self, fn: Callable, takes: Kind | None = None, gives: Kind | None = None) -> Step:
        """An array-valued function on columns, or a generator of values with hints; order is kept, and so is the parent's time."""
        keys = [*self.keys, f"k{len(self.keys)}"]
        if on_values(fn):
            (own,), _ = signature(fn, 1, returns=False)
            if gives is None:
                raise TypeError("say what the generator gives")
            up = self.code(own)
            return up._next("flat", gives, _generated(fn, keys, gives), keys)
        _columns(fn, 1)
        up = self if takes is None else self.code(takes)

        def build(df: DataFrame, _: Options) -> DataFrame:
            return df.select(*self.keys, "ts", F.posexplode(fn(F.col("value"))).alias(keys[-1], "value"))

        return up._next("flat", gives or up.kind, build, keys)

    def process(self, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], gives: Kind, takes: Kind = ANY) -> Step:
        """The general element function: Arrow batches of keys, ts and value in, none or more out, with one key more (its place among its input's outputs)."""
        up = self.code(takes)
        keys = [*self.keys, f"k{len(self.keys)}"]

        def build(df: DataFrame, o: Options) -> DataFrame:
            own = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in self.keys)
            return _tasks(df, o).mapInPandas(_sliced(fn, o), f"{own}, {keys[-1]} int, ts timestamp, value {gives.ddl}")

        return up._next("flat", gives, build, keys)

    def fold(self, how: Fold | Callable, init: Any = None) -> Step:
        """A global left fold in order. It isn't reset at a trigger, emits once more at the end if anything came since, and nothing on empty input."""
        if isinstance(how, Fold):
            up = self.code(how.takes)
            step = up._next("fold", how.gives, lambda df, o: _running(df, up.keys, how, o, self.flow.scratch, step.carry), ["k0"])
            return step
        (state, own), result = signature(how, 2)
        if init is None or result != state:
            raise TypeError("a fold's function maps (state, element) to a state and needs an initial one")
        up = self.code(own)
        step = up._next("fold", result, lambda df, o: _sequential(df, up.keys, how, init, result, o, self.flow.scratch, step.carry), ["k0"])
        return step

    def count(self) -> Step:
        return self.fold(Fold("sum", lambda v: F.lit(1).cast("bigint"), 0))

    def spread(self, n: int | None = None) -> Step:
        """Elements over peers in turn; binary in and out. The set of results doesn't change."""
        up = self.code(BINARY)
        return up._next("exchange", BINARY, lambda df, _: df.repartition(n or df.sparkSession.sparkContext.defaultParallelism))

    def gather(self) -> Step:
        """All elements in their order again: a range partitioning and sort, not one task; gaps don't matter."""
        up = self.code(BINARY)
        return up._next("exchange", BINARY, lambda df, _: df.orderBy(*up.keys))

    def numbered(self) -> DataFrame:
        """The frame with rn, its elements' places in order."""
        return numbered(self.frame(), self.keys, self.flow.scratch)

    def to(self, sink) -> Any:
        """Write to a sink of brookline.sources.sinks."""
        self._validate()
        up = self.code(sink.takes)
        return sink.write(up, self.options)


def _columns(fn: Callable, arguments: int) -> None:
    if not callable(fn):
        raise TypeError("a function is wanted")
    try:
        n = len(inspect.signature(fn).parameters)
    except ValueError:
        return
    if n != arguments:
        raise TypeError(f"a function of {arguments} argument(s) is wanted, not {n}")


def _apply(fn: Callable[[Column], Column], python: bool = False):
    return lambda df, o: (_tasks(df, o) if python else df).withColumn("value", fn(F.col("value")))


def _tasks(df: DataFrame, o: Options) -> DataFrame:
    """No more tasks than were asked for; without a shuffle."""
    return df.coalesce(o.par) if o.par > 1 else df


def _sliced(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], o: Options) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    if not o.bounded:
        return fn
    n = o.buffer
    return lambda batches: fn(pdf.iloc[at : at + n].reset_index(drop=True) for pdf in batches for at in range(0, len(pdf), n))


def _paced(df: DataFrame, gap: float) -> DataFrame:
    """The same rows, no faster than one in `gap` seconds: one task, since a rate is one of all together."""

    def run(batches):
        due, most = time.monotonic(), max(1, int(0.05 / gap) if gap else 1 << 20)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                due = max(due, time.monotonic() - 1) + part.num_rows * gap
                time.sleep(max(0.0, due - time.monotonic()))
                yield part

    return df.coalesce(1).mapInArrow(run, df.schema)


def _vectorised(fn: Callable, gives: Kind) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x)).astype(object)

    return F.pandas_udf(run, gives.ddl)


def _prepared(mapper: Mapper) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = mapper.prepare()
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(x)).astype(object)

    return F.pandas_udf(run, mapper.gives.ddl)


def _generated(fn: Callable, keys: list[str], gives: Kind):
    def build(df: DataFrame, o: Options) -> DataFrame:
        own = keys[:-1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(*row[:-2], pos, row[-2], x) for row in pdf[[*own, "ts", "value"]].itertuples(index=False, name=None) for pos, x in enumerate(fn(row[-1]))]
                yield pd.DataFrame(rows, columns=[*keys, "ts", "value"]).astype({"ts": "datetime64[ns]"})

        kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in own)
        return _tasks(df, o).select(*own, "ts", "value").mapInPandas(_sliced(run, o), f"{kinds}, {keys[-1]} int, ts timestamp, value {gives.ddl}")

    return build


def _running(df: DataFrame, keys: list[str], how: Fold, options: Options, scratch: Scratch, carry: dict | None = None) -> DataFrame:
    part = how.of(F.col("value"))
    if df.isStreaming:
        raise ValueError("a fold of a stream is kept while it runs: see Step.run")
    aggregate = {"sum": F.sum, "max": F.max, "min": F.min}[how.combine]
    if carry is not None:
        return _carried(df, keys, how, options, scratch, carry, aggregate, part)
    if not options.each:
        whole = df.groupBy().agg(aggregate(part).alias("a"), F.count("*").alias("n"), F.max("ts").alias("ts"), F.max(keys[0]).alias("uniq")).where("n > 0")
        both = F.col("a") + F.lit(how.init) if how.combine == "sum" else (F.greatest if how.combine == "max" else F.least)("a", F.lit(how.init))
        acc = F.col("a") if how.init is None else both
        return whole.select(F.lit(1).cast("bigint").alias("k0"), "ts", acc.cast(how.gives.ddl).alias("value"), "uniq")
    placed = numbered(df.select(*keys, "ts", part.alias("part")), keys, scratch)
    out = running(placed, keys, options.each, F.col("part"), how.combine, how.init)
    return out.select(F.col("emit_no").alias("k0"), "ts", F.col("acc").cast(how.gives.ddl).alias("value"), "uniq")


def _carried(df: DataFrame, keys: list[str], how: Fold, options: Options, scratch: Scratch, carry: dict, aggregate: Callable, part: Column) -> DataFrame:
    """One micro-batch of a fold: it goes on from what was carried, and emits at each `each` elements, or (with every) once for the batch."""
    placed = numbered(df.select(*keys, "ts", part.alias("part")), keys, scratch)
    total = placed.agg(F.count("*").alias("n"), aggregate("part").alias("a"), F.max("ts").alias("ts"), F.max(keys[0]).alias("uniq")).first()
    before, acc = carry.get("n", 0), carry.get("acc", how.init)
    _remember(carry, before + total["n"], total, options)
    if total["a"] is not None:
        carry["acc"] = total["a"] if acc is None else {"sum": lambda a, b: a + b, "max": max, "min": min}[how.combine](acc, total["a"])
    else:
        carry["acc"] = acc
    if options.each:
        out = running(placed.withColumn("rn", F.col("rn") + before), keys, options.each, F.col("part"), how.combine, acc)
        out = out.where(F.col("emit_no") * options.each <= before + total["n"])
        return out.select(F.col("emit_no").alias("k0"), "ts", F.col("acc").cast(how.gives.ddl).alias("value"), "uniq")
    return rest_of(df, keys, how.gives, carry, bool(options.every) and total["n"] > 0)


def _remember(carry: dict, n: int, last: Any, options: Options) -> None:
    """Of a fold: how many elements came, the last one's key and time, how often it emitted, and whether anything came since."""
    if n == carry.get("n", 0):
        carry.setdefault("n", 0)
        return
    carry.update(n=n, ts=last["ts"], uniq=last["uniq"])
    carry["emitted"] = n // options.each if options.each else carry.get("emitted", 0) + bool(options.every)
    carry["due"] = n % options.each > 0 if options.each else not options.every


def rest_of(df: DataFrame, keys: list[str], gives: Kind, carry: dict, emit: bool) -> DataFrame:
    """A frame of the carried value, or an empty one."""
    schema = f"k0 bigint, ts timestamp, value {gives.ddl}, uniq {df.schema[keys[0]].dataType.simpleString()}"
    rows = [(carry["emitted"], carry["ts"], carry["acc"], carry["uniq"])] if emit else []
    return df.sparkSession.createDataFrame(rows, schema)


def _sequential(df: DataFrame, keys: list[str], fn: Callable, init: Any, gives: Kind, options: Options, scratch: Scratch, carry: dict | None = None) -> DataFrame:
    """A fold of unknown algebra is sequential by nature: one ordered task, over Arrow batches, which keeps the state and one batch in memory."""
    if df.isStreaming:
        raise ValueError("a fold of a stream is kept while it runs: see Step.run")
    each, begun, first = options.each, carry is not None, (carry or {}).get("acc", init)
    before, shown = (carry or {}).get("n", 0), (carry or {}).get("emitted", 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, n, emitted, last = first, before, shown, None
        frame = lambda rows: pd.DataFrame(rows, columns=["k0", "ts", "value", "uniq"]).astype({"ts": "datetime64[ns]"})
        for pdf in batches:
            out = []
            for key, ts, x in pdf.itertuples(index=False, name=None):
                state, n, last = fn(state, x), n + 1, (ts, key)
                if each and n % each == 0:
                    emitted += 1
                    out.append((emitted, *last[:1], state, last[1]))
                    last = None if not begun else last
            if out:
                yield frame(out)
        if begun and n > before:  # the state for the next micro-batch, as a row that isn't an emission
            yield frame([(-n, last[0], state, last[1])])
        elif last is not None:
            yield frame([(emitted + 1, last[0], state, last[1])])

    kind = df.schema[keys[0]].dataType.simpleString()
    one = df.select(*keys, "ts", "value").repartition(1).sortWithinPartitions(*keys).select(F.col(keys[0]).alias("key"), "ts", "value")
    out = one.mapInPandas(run, f"k0 bigint, ts timestamp, value {gives.ddl}, uniq {kind}")
    if carry is None:
        return out
    held = scratch.keep(out, "fold")
    last = held.where("k0 < 0").first()
    carry.setdefault("acc", init)
    if last is None:
        carry.setdefault("n", 0)
        return held
    _remember(carry, -last["k0"], last, options)
    carry["acc"] = last["value"]
    return rest_of(df, keys, gives, carry, True) if options.every and not each else held.where("k0 > 0")


__all__ = ["DOUBLE", "Flow", "Fold", "Mapper", "Options", "Step"]
