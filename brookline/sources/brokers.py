"""Message brokers: Kafka by Spark's connector, AMQP 0-9-1 by a data source over an injected client.

Neither connector's library is a dependency. Kafka needs Spark's package on the class path; AMQP
needs a function that returns a client with the few methods of AmqpClient. Spark reads a source in a
process of its own, so the function goes there: by its name ("module:name"), or as it is.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from brookline.functions.basic import headers_last_wins
from brookline.types import BINARY, KVM


class Kafka:
    """A topic from its earliest offset (unless said otherwise), with headers; offsets are in the query's checkpoint, never committed by the consumer."""

    kind = KVM

    def __init__(self, topic: str, servers: str, streaming: bool = True, options: dict[str, str] | None = None, per_trigger: int = 0):
        if options and options.get("kafka.enable.auto.commit", "false") != "false":
            raise ValueError("offsets are committed with the checkpoint, not by the consumer")
        self.options = {"subscribe": topic, "kafka.bootstrap.servers": servers, "includeHeaders": "true", "startingOffsets": "earliest", **(options or {})}
        if per_trigger:
            self.options["maxOffsetsPerTrigger"] = str(per_trigger)
        self.streaming = streaming

    def admit(self, n: int) -> Kafka:
        """The same topic, at most n elements a trigger."""
        out = Kafka.__new__(Kafka)
        out.options, out.streaming = {**self.options, "maxOffsetsPerTrigger": str(n)}, self.streaming
        return out

    def raw(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream if self.streaming else spark.read
        return reader.format("kafka").options(**self.options).load()

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.elements(self.raw(spark))

    @staticmethod
    def elements(raw: DataFrame) -> DataFrame:
        """Rows as Spark's connector gives them to elements, ordered by partition and offset."""
        headers = F.coalesce(headers_last_wins(F.col("headers")), F.create_map().cast("map<string,binary>"))
        value = F.struct(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), headers.alias("headers"))
        return raw.select(F.struct("partition", "offset").alias("k0"), F.date_trunc("second", "timestamp").alias("ts"), value.alias("value"))


class AmqpClient(Protocol):
    def bind(self, queue: str, exchange: str, key: str) -> None: ...
    def qos(self, count: int, size: int) -> None: ...
    def get(self, queue: str) -> tuple[int, float, bytes] | None:
        """The next delivery that isn't acknowledged: tag, time, body."""

    def ack(self, tag: int, multiple: bool) -> None: ...
    def publish(self, exchange: str, key: str, body: bytes, persistent: bool) -> bool:
        """True when the broker has confirmed it."""

    def declare(self, exchange: str, kind: str, queue: str, durable: bool) -> None: ...


def portable(connect: str | Callable[[], AmqpClient]) -> str:
    """A client's function as the text of an option."""
    return connect if isinstance(connect, str) else "pickle:" + base64.b64encode(cloudpickle.dumps(connect)).decode()


def connect(spec: str) -> AmqpClient:
    if spec.startswith("pickle:"):
        return cloudpickle.loads(base64.b64decode(spec[7:]))()
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)()


def declare_exchange(client: AmqpClient, exchange: str, kind: str, queue: str) -> None:
    """A durable exchange and a durable queue."""
    client.declare(exchange, kind, queue, True)


class AmqpReader(SimpleDataSourceStreamReader):
    """Deliveries up to the prefetch count a batch; a finished batch is acknowledged up to its last tag (at least once: what was
    finished but not acknowledged when a connection broke comes again).

    Tags count from 1 in each connection, so an offset is what was committed before it plus the tag.
    """

    def __init__(self, options: dict[str, str], prompt: bool = False):
        """prompt: a batch is acknowledged when what is after it is asked for, not only by commit()."""
        self.prompt = prompt
        self.queue, self.count = options["queue"], int(options.get("prefetch_count", "100"))
        self.client = connect(options["client"])
        if options.get("binding_key"):
            self.client.bind(self.queue, options.get("exchange", ""), options["binding_key"])
        self.client.qos(self.count, int(options.get("prefetch_size", "0")))
        self.base: int | None = None
        self.last = 0

    def initialOffset(self) -> dict:
        return {"tag": 0}

    def _deliveries(self, start: dict, most: int) -> list[tuple]:
        if self.base is None:
            self.base = start["tag"]
        rows: list[tuple] = []
        while len(rows) < most and (delivery := self.client.get(self.queue)):
            tag, time, body = delivery
            rows.append((self.base + tag, float(time), bytes(body)))
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Spark asks for what is after a batch when that batch is done, but commits it only when there is more: a full prefetch window would let nothing more come."""
        if self.prompt and self.base is not None:
            self.commit(start)
        rows = self._deliveries(start, self.count)
        return iter(rows), {"tag": rows[-1][0] if rows else start["tag"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A broker redelivers in order what wasn't acknowledged, so a batch is read again from it."""
        return iter(self._deliveries(start, end["tag"] - start["tag"]))

    def commit(self, end: dict) -> None:
        if self.base is not None and end["tag"] > max(self.last, self.base):
            self.client.ack(end["tag"] - self.base, True)
            self.last = end["tag"]


class AmqpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brookline_amqp"

    def schema(self) -> str:
        return "tag bigint, time double, body binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return AmqpReader(self.options, prompt=True)


class Amqp:
    kind = BINARY

    def __init__(self, client: str | Callable[[], AmqpClient], queue: str, exchange: str = "", binding_key: str = "", prefetch_count: int = 100, prefetch_size: int = 0):
        self.options = {"client": portable(client), "queue": queue, "exchange": exchange, "binding_key": binding_key, "prefetch_count": str(prefetch_count), "prefetch_size": str(prefetch_size)}

    def admit(self, n: int) -> Amqp:
        """The same queue, with at most n deliveries that aren't acknowledged."""
        out = Amqp.__new__(Amqp)
        out.options = {**self.options, "prefetch_count": str(n)}
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(AmqpSource)
        df = spark.readStream.format("brookline_amqp").options(**self.options).load()
        return df.select(F.col("tag").alias("k0"), F.timestamp_seconds(F.floor("time")).alias("ts"), F.col("body").alias("value"))
