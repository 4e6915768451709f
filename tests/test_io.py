"""Files, brokers, sinks and streams."""

import gzip
import io
import time

import pytest
from pyspark.sql import functions as F

from brookline.operators.flow import Flow, Fold
from brookline.sources import brokers
from brookline.sources.brokers import Kafka
from brookline.sources.files import Contents, Directory, Lines, read_urls
from brookline.sources.sequence import Items
from brookline.sources.sinks import AmqpSink, Callback, KafkaSink, Out, PerTask, Reporting
from brookline.streaming import runner
from brookline.types import KVM, LONG, STRING


def test_directory_reader_and_lines(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo\r\nlast")
    (tmp_path / "a.txt").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    step = Flow(spark).source(Directory(str(tmp_path)))
    rows = [r["value"] for r in step.ordered().collect()]
    assert [r["name"] for r in rows] == ["a.txt", "b.txt", "sub"] and rows[0]["proto"] == "file"
    files = step.frame().where("value.name <> 'sub'")
    assert {bytes(r["value"]) for r in read_urls(files).collect()} == {b"x", b"one\n\ntwo\r\nlast"}
    with pytest.raises(Exception, match="directory|No such"):
        read_urls(step.frame().where("value.name = 'sub'")).collect()
    assert [bytes(r["value"]) for r in Flow(spark).source(Contents(f"{tmp_path}/*.txt")).ordered().collect()] == [b"x", b"one\n\ntwo\r\nlast"]
    assert [r["value"] for r in Flow(spark).source(Lines(f"{tmp_path}/b.txt")).ordered().collect()] == ["one", "two\r", "last"]
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"p\nq\n"))
    assert [r["value"] for r in Flow(spark).source(Lines(f"{tmp_path}/c.gz")).ordered().collect()] == ["p", "q"]


def test_out_writes_lines_in_order(spark):
    to = io.StringIO()
    assert Flow(spark).source(Items(["a", "b", None])).to(Out(to)) == 3
    assert to.getvalue() == "a\nb\n\n"


def test_callback_flushes(spark):
    log = []
    sink = Callback(log.append, lambda: log.append("|"), STRING, lambda: log.append("end"))
    Flow(spark).source(Items(list("abcde"))).each(2).to(sink)
    assert log == ["a", "b", "|", "c", "d", "|", "e", "|", "end"]
    log.clear()
    Flow(spark).source(Items(list("ab"))).to(sink)
    assert log == ["a", "b", "|", "end"]


def test_kafka_rows(spark):
    raw = spark.createDataFrame([(0, 2, b"k", b"v", 1_700_000_000.9, [("h", b"1"), ("h", b"2")]), (0, 1, None, b"w", 5.0, None)], "partition int, offset bigint, key binary, value binary, t double, headers array<struct<key:string,value:binary>>").withColumn("timestamp", F.timestamp_seconds("t"))
    rows = Kafka.elements(raw).orderBy("k0").collect()
    assert [bytes(r["value"]["value"]) for r in rows] == [b"w", b"v"]
    assert bytes(rows[1]["value"]["headers"]["h"]) == b"2" and rows[1]["ts"].microsecond == 0 and rows[0]["value"]["headers"] == {}
    source = Kafka("t", "host:1", per_trigger=5)
    assert source.options["startingOffsets"] == "earliest" and source.options["maxOffsetsPerTrigger"] == "5" and source.kind == KVM
    with pytest.raises(ValueError):
        Kafka("t", "h", options={"kafka.enable.auto.commit": "true"})
    step = Flow(spark).source(Items(["x"])).code(KVM)
    row = KafkaSink("topic", "host:1").rows(step).first()
    assert (row["key"], bytes(row["value"]), row["headers"], row["topic"]) == (None, b"x", [], "topic")
    stamped = KafkaSink("topic", "host:1", stamp="at").rows(Flow(spark).table(raw, "offset", F.struct(F.col("key"), F.col("value"), F.create_map(F.lit("at"), F.lit(b"?"), F.lit("h"), F.lit(b"1")).alias("headers")), KVM, F.col("timestamp")))
    assert {tuple((h["key"], bytes(h["value"])) for h in r["headers"]) for r in stamped.collect()} == {(("h", b"1"), ("at", b"1700000000")), (("h", b"1"), ("at", b"5"))}
    with pytest.raises(ValueError):
        KafkaSink("topic", "host:1").write(Flow(spark).table(spark.readStream.format("rate").load(), "value", "value", LONG).map(lambda v: F.struct(F.lit(None).cast("binary").alias("key"), v.cast("string").cast("binary").alias("value"), F.create_map().cast("map<string,binary>").alias("headers")), gives=KVM), None)


class Broker:
    """A fake of the client protocol, with a log."""

    def __init__(self, bodies=()):
        self.waiting, self.log = [(i, 10.0 + i, b) for i, b in enumerate(bodies, 1)], []

    def bind(self, *a):
        self.log.append(("bind", *a))

    def qos(self, *a):
        self.log.append(("qos", *a))

    def get(self, queue):
        return self.waiting.pop(0) if self.waiting else None

    def ack(self, *a):
        self.log.append(("ack", *a))

    def declare(self, *a):
        self.log.append(("declare", *a))


def test_amqp_reader():
    broker = Broker([b"a", b"b", b"c"])
    r = brokers.AmqpReader({"client": brokers.portable(lambda: broker), "queue": "q", "exchange": "e", "binding_key": "k", "prefetch_count": "2"})
    broker = r.client  # the function went through its text
    rows, end = r.read(r.initialOffset())
    assert [x[2] for x in rows] == [b"a", b"b"] and end == {"tag": 2}
    r.commit(end)
    r.commit(end)
    rows, end = r.read(end)
    assert [x[0] for x in rows] == [3]
    assert r.read(end)[1] == {"tag": 3}
    assert broker.log == [("bind", "q", "e", "k"), ("qos", 2, 0), ("ack", 2, True)]
    brokers.declare_exchange(broker, "e", "topic", "q")
    assert broker.log[-1] == ("declare", "e", "topic", "q", True)


class FileBroker:
    """A queue in a folder: lines that wait, and how many are acknowledged. A connection counts its deliveries from 1."""

    def __init__(self, at):
        self.at, self.tag = at, 0
        self.base = self.acknowledged()

    def acknowledged(self):
        return int(open(f"{self.at}/acks").read().split()[-1])

    def bind(self, *a):
        pass

    def qos(self, count, size):
        self.count = count

    def get(self, queue):
        waiting = open(f"{self.at}/{queue}").read().split()
        if self.base + self.tag >= len(waiting) or self.base + self.tag - self.acknowledged() >= self.count:
            return None
        self.tag += 1
        return self.tag, 10.5 + self.tag, waiting[self.base + self.tag - 1].encode()

    def ack(self, tag, multiple):
        with open(f"{self.at}/acks", "a") as f:
            f.write(f"{self.base + tag}\n")


def test_amqp_stream_acknowledges_and_restarts(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "acks").write_text("0\n")
    (tmp_path / "q").write_text("a\nb\nc\n")

    def connect():
        return FileBroker(at)

    got = []
    for more in ("", "d\ne\n"):
        with open(f"{at}/q", "a") as f:
            f.write(more)
        step = Flow(spark).source(brokers.Amqp(connect, "q", "e", "k")).buffer(2).code(STRING).map(F.upper)
        query = step.run(lambda df: got.extend(r["value"] for r in df.orderBy("k0").collect()), f"{at}/ck")
        for _ in range(300):
            if len(got) >= (5 if more else 3):
                break
            time.sleep(0.1)
        query.finish()
    assert got == ["A", "B", "C", "D", "E"]
    acks = [int(x) for x in (tmp_path / "acks").read_text().split()]
    assert acks == sorted(acks) and acks[-1] >= 3


def test_amqp_sink(spark, tmp_path):
    at = str(tmp_path / "sent")

    class Confirming:
        def publish(self, exchange, key, body, persistent):
            with open(at, "ab") as f:
                f.write(body + b"\n")
            return body != b"bad"

    Flow(spark).source(Items(["a", "b"])).to(AmqpSink(Confirming, "e", "k"))
    assert sorted(open(at, "rb").read().split()) == [b"a", b"b"]
    Flow(spark).source(Items(list("qponm"))).to(AmqpSink(Confirming, "e", "k", ordered=True))
    assert open(at, "rb").read().split()[2:] == [b"q", b"p", b"o", b"n", b"m"]
    with pytest.raises(Exception, match="confirm"):
        Flow(spark).source(Items(["bad"])).to(AmqpSink(Confirming, "e", "k"))


def add(acc, v):
    return acc + v


def test_stream_fold_restarts_from_its_checkpoint(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.range(1, 8).withColumnRenamed("id", "value").withColumn("k", F.col("value")).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("value bigint, k bigint").parquet(src)
        q = runner.fold_each(stream, "k", add, 0, 3).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        q.awaitTermination(120)

    run()
    spark.range(8, 11).withColumnRenamed("id", "value").withColumn("k", F.col("value")).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 6), (2, 21), (3, 45)]


def test_stream_count(spark, tmp_path):
    q = runner.count_every(spark.readStream.format("rate").option("rowsPerSecond", 50).load(), 0.5, "ticks")
    for _ in range(60):
        time.sleep(0.5)
        if spark.table("ticks").count() and spark.table("ticks").first()["n"]:
            break
    assert spark.table("ticks").first()["n"] > 0
    q.stop()


class Log:
    """A task's sink, with a file for each task."""

    def __init__(self, at):
        import uuid

        self.to = open(f"{at}/{uuid.uuid4().hex}", "w")

    def process(self, v):
        self.to.write(f"{v} ")

    def flush(self):
        self.to.write("| ")

    def close(self):
        self.to.write("end")
        self.to.close()


def test_sink_in_tasks(spark, tmp_path):
    at = str(tmp_path)
    Flow(spark).table(spark.range(1, 6, numPartitions=3).coalesce(1), "id", "id", LONG).each(2).to(PerTask(lambda: Log(at)))
    logs = [p.read_text() for p in tmp_path.iterdir()]
    assert all(x.endswith("| end") for x in logs)
    assert sorted(int(v) for x in logs for v in x.split() if v.isdigit()) == [1, 2, 3, 4, 5]


class Written(Log):
    """A task's sink that says how many elements it flushed."""

    n = 0

    def process(self, v):
        super().process(v)
        self.n += 1

    def flush(self):
        super().flush()
        n, self.n = self.n, 0
        return n


@pytest.mark.parametrize(("each", "want"), [(0, [(1, 1000)]), (7, [(k, 7) for k in range(1, 143)] + [(143, 6)]), (250, [(k, 250) for k in range(1, 5)]), (5000, [(1, 1000)])])
def test_sink_in_tasks_counts_the_whole_order(spark, tmp_path, monkeypatch, each, want):
    """Flushes that lie in more than one task are reported whole; elements are in order between flushes and each comes once."""
    at = str(tmp_path)
    monkeypatch.setattr(Reporting, "ROWS", 3)
    step = Flow(spark).table(spark.range(1000, numPartitions=5).withColumn("key", (F.col("id") * 387) % 1000), "key", "key", LONG)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        assert sorted(map(tuple, step.each(each).to(Reporting(lambda: Written(at))).collect())) == want
    finally:
        spark.conf.unset(coalesced)
    logs = [p.read_text() for p in tmp_path.iterdir()]
    assert sum("|" in x for x in logs) > 1
    stretches = [[int(v) for v in part.split()] for x in logs for part in x.removesuffix("end").split("|") if part.split()]
    assert all(s == list(range(s[0], s[-1] + 1)) and (not each or s[0] // each == s[-1] // each) for s in stretches)
    assert sorted(v for s in stretches for v in s) == list(range(1000))


@pytest.mark.parametrize(("each", "want"), [(0, [(1, 0)]), (3, [])])
def test_sink_in_tasks_without_elements(spark, tmp_path, each, want):
    at = str(tmp_path)
    step = Flow(spark).table(spark.range(0), "id", "id", LONG)
    assert list(map(tuple, step.each(each).to(Reporting(lambda: Written(at))).collect())) == want


def appended(spark, at, low, high):
    spark.range(low, high).select(F.col("id").alias("value"), F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(at)


def flow_over(spark, at):
    stream = spark.readStream.schema("value bigint, k bigint").option("maxFilesPerTrigger", 1).parquet(at)
    return Flow(spark).table(stream, "k", "value", LONG)


def test_flow_over_a_stream_folds_as_over_a_batch(spark, tmp_path):
    """Triggers across micro-batches, the rest at the end, a restart, folds of folds, and functions without a parallel form."""
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    appended(spark, src, 1, 5)
    appended(spark, src, 5, 8)

    def run(build, folder):
        got = []
        build(flow_over(spark, src)).run(lambda df: got.extend((r["k0"], r["value"]) for r in df.orderBy("k0").collect()), f"{ck}/{folder}", once=True)
        return got

    total = lambda s: s.map(lambda v: v * 10).fold(Fold("sum", lambda v: v)).each(3)
    assert run(total, "sum") == [(1, 60), (2, 210), (3, 280)]
    assert run(lambda s: s.fold(lambda_fold, 0).each(3), "seq") == [(1, 11), (2, 120), (3, 247)]
    assert [v for _, v in run(lambda s: s.count(), "count")] == [7]
    assert [v for _, v in run(lambda s: s.count().every(0.1), "every")] == [4, 7]
    assert [v for _, v in run(lambda s: s.count().each(2).count().each(3), "nested")] == [3, 4]
    assert [v for _, v in run(lambda s: s.fold(Fold("max", lambda v: -v, None)).each(5), "max")] == [-1, -1]
    assert run(lambda s: s.filter(lambda v: v > 99).count().each(2), "none") == []
    appended(spark, src, 8, 10)
    assert run(total, "sum") == [(3, 450)] and run(lambda s: s.count(), "count")[0][1] == 9


def test_flow_over_a_stream_is_limited_across_restarts(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    appended(spark, src, 1, 4)
    got = []
    run = lambda: flow_over(spark, src).filter(lambda v: v != 2).limit(3).run(lambda df: got.extend(r["value"] for r in df.orderBy("k0").collect()), ck, once=True)
    run()
    assert got == [1, 3]
    appended(spark, src, 4, 9)
    run()
    run()
    assert got == [1, 3, 4]
    with pytest.raises(ValueError):
        flow_over(spark, src).limit(3).frame()
    with pytest.raises(ValueError):
        flow_over(spark, src).count().frame()
    with pytest.raises(ValueError):
        Flow(spark).source(Items(["a"])).run(print, ck)


def test_a_reached_limit_stops_the_stream(spark, tmp_path):
    got = []
    stream = spark.readStream.format("rate").option("rowsPerSecond", 100).option("numPartitions", 1).load()
    query = Flow(spark).table(stream, "value", "value", LONG).limit(25).run(lambda df: got.extend(r["value"] for r in df.orderBy("k0").collect()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert not query.isActive and got == list(range(25))


def test_throttle_takes_its_time(spark):
    began = time.time()
    assert Flow(spark).source(Items(list("abcdefgh"))).throttle(4, 1.0).frame().count() == 8
    assert time.time() - began >= 2.0


def lambda_fold(acc: int, v: int) -> int:
    return acc * 2 + v
