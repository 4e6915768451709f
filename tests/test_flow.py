"""Elements, folds, options and types of flows."""

from collections.abc import Iterator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookline.functions import basic, xml
from brookline.functions.registry import DEFAULT, Codec, path
from brookline.operators.flow import Flow, Fold, Mapper
from brookline.sources.sequence import Cycle, Items
from brookline.types import ANY, BINARY, INT, KV, KVM, LONG, PYTHON, STRING, URL, XML, record


def values(step):
    return [r["value"] for r in step.ordered().select("value").collect()]


def numbers(spark, n, parts=1):
    return Flow(spark).table(spark.range(1, n + 1, numPartitions=parts), "id", "id", LONG)


def test_list_and_cycle(spark):
    assert values(Flow(spark).source(Items(["b", "a", "c"]))) == ["b", "a", "c"]
    assert values(Flow(spark).source(Cycle(5, ["x", "y"]))) == ["x", "y", "x", "y", "x"]
    assert values(Flow(spark).source(Cycle(0, []))) == []
    assert values(Flow(spark).source(Items([]))) == []
    with pytest.raises(ValueError):
        Cycle(1, [])


def test_cycle_of_a_long_list(spark):
    got = values(Flow(spark).source(Cycle(3000, [f"v{i}" for i in range(1500)])))
    assert got == [f"v{i % 1500}" for i in range(3000)]


def test_golden_running_byte_length(spark):
    names = ["Adam", "Viktor", "Anna", "Bea", "Cyril", "Bob", "Dora", "Ben", "Emil", "Bruno", "Franz", "Gwen"]
    step = Flow(spark).source(Cycle(1200, [f"<name>{n}</name>" for n in names])).map(lambda v: xml.first_text(v, "/name"), takes=XML, gives=STRING)
    step = step.filter(lambda v: ~v.contains("B")).par(4).fold(Fold("sum", lambda v: F.octet_length(v).cast("bigint"))).each(100)
    kept = [names[i % 12] for i in range(1200) if "B" not in names[i % 12]]
    want = [sum(map(len, kept[:i])) for i in range(100, len(kept) + 1, 100)]
    assert values(step) == want


def test_golden_scatter_gather(spark):
    step = Flow(spark).source(Items(["aaa\tbbb", "ccc", "ddd\teee\tfff", "ggg", "hhh"])).flat_map(lambda v: basic.literal_split(v, "\t")).par(4)
    step = step.spread(3).code(STRING).map(F.upper).gather().code(STRING)
    assert values(step) == ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF", "GGG", "HHH"]


@pytest.mark.parametrize("parts", [1, 4, 8])
@pytest.mark.parametrize(("n", "each"), [(10, 3), (9, 3), (1, 5), (10, 1)])
def test_triggered_fold_is_cumulative_and_flushes_once_at_the_end(spark, parts, n, each):
    want = [sum(range(1, i + 1)) for i in range(1, n + 1) if i % each == 0 or i == n]
    assert values(numbers(spark, n, parts).fold(Fold("sum", lambda v: v)).each(each)) == want


def test_fold_of_nothing_emits_nothing(spark):
    empty = numbers(spark, 5).filter(lambda v: v > 9)
    assert values(empty.count()) == []
    assert values(numbers(spark, 5).filter(lambda v: v > 9).count().each(2)) == []
    assert values(numbers(spark, 5).filter(lambda v: v > 9).fold(lambda_fold, 0)) == []


def lambda_fold(acc: int, v: int) -> int:
    return acc * 2 + v


def test_sequential_fold_keeps_order(spark):
    acc, want = 0, []
    for i in range(1, 11):
        acc = lambda_fold(acc, i)
        if i % 4 == 0 or i == 10:
            want.append(acc)
    assert values(numbers(spark, 10, 4).fold(lambda_fold, 0).each(4)) == want


def test_fold_of_fold_and_limits(spark):
    assert values(numbers(spark, 10).count().each(3).count().each(1)) == [1, 2, 3, 4]
    assert values(numbers(spark, 10).count().each(3).limit(2)) == [3, 6]
    assert values(numbers(spark, 10, 4).limit(3)) == [1, 2, 3]
    assert values(numbers(spark, 10, 4).limit(0)) == list(range(1, 11))
    assert values(numbers(spark, 3).limit(99)) == [1, 2, 3]
    assert values(numbers(spark, 10, 4).filter(lambda v: v % 2 == 0).limit(2)) == [2, 4]
    assert values(numbers(spark, 4).flat_map(lambda v: F.array(v, -v)).limit(3)) == [1, -1, 2]
    assert values(numbers(spark, 4).map(lambda v: v * 2).par(4).limit(3)) == [2, 4, 6]


def test_limit_is_a_top_k_plan(spark):
    plan = numbers(spark, 10).limit(3).frame()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def some(v: int) -> Iterator[int]:
    yield from range(v % 3)


def test_flat_map_of_values_keeps_order_and_may_be_empty(spark):
    assert values(numbers(spark, 5, 2).flat_map(some, gives=LONG)) == [0, 0, 1, 0, 0, 1]


class Prefix(Mapper):
    takes, gives = STRING, STRING

    def prepare(self):
        made = []
        return lambda v: (made.append(v), f"{v}-{min(len(made), 1)}")[1]


def shout(v: str) -> str:
    return v.upper() + "!"


def long_enough(v: str) -> bool:
    return len(v) > 1


def test_python_values_and_nulls(spark):
    step = Flow(spark).source(Items(["a", None, "bc"]))
    assert values(step.map(shout)) == ["A!", None, "BC!"]
    assert values(Flow(spark).source(Items(["a", None, "bc"])).filter(long_enough)) == ["bc"]
    assert values(Flow(spark).source(Items(["a", "b"])).map(Prefix())) == ["a-1", "b-1"]


def test_codecs_come_in_by_themselves(spark):
    step = Flow(spark).source(Items(["é"])).code(KVM)
    assert step.kind == KVM and values(step)[0]["headers"] == {}
    assert values(step.map(shout)) == ["É!"]


def test_declaration_errors(spark):
    step = numbers(spark, 3)
    with pytest.raises(TypeError):
        step.map(lambda a, b: a)
    with pytest.raises(TypeError):
        step.fold(lambda_fold)
    with pytest.raises(TypeError):
        step.filter(shout_length)
    with pytest.raises(TypeError):
        numbers(spark, 3).code(XML)
    with pytest.raises(ValueError):
        numbers(spark, 3).count().map(lambda v: v)
    with pytest.raises(ValueError):
        numbers(spark, 3).par(2).map(lambda v: v)
    with pytest.raises(ValueError):
        Fold("median", lambda v: v)
    with pytest.raises(ValueError):
        numbers(spark, 3).limit(-1)


def shout_length(v: str) -> int:
    return len(v)


def test_option_defaults(spark):
    o = numbers(spark, 1).options
    assert (o.par, o.buffer, o.each, o.every, o.limit, o.throttle) == (1, 32, 0, 0.0, 0, 0.0)
    step = numbers(spark, 1).buffer(7).throttle(4, 2.0).every(1.5)
    assert (step.options.buffer, step.options.throttle, step.options.every) == (7, 0.5, 1.5)


@pytest.mark.parametrize(
    ("given", "wanted", "names"),
    [
        (STRING, XML, ["text_encode", "xml_decode"]),
        (XML, STRING, ["xml_encode", "text_decode"]),
        (STRING, BINARY, ["text_encode"]),
        (BINARY, STRING, ["text_decode"]),
        (STRING, KVM, ["text_encode", "kvm_no_meta"]),
        (KVM, STRING, ["kvm_ignore_meta", "text_decode"]),
        (KVM, XML, ["kvm_ignore_meta", "xml_decode"]),
        (KV, STRING, ["kv_ignore_key", "text_decode"]),
        (KVM, KV, ["kvm_ignore_meta", "kv_nil_key"]),
        (URL, KVM, ["url_encode", "kvm_no_meta"]),
    ],
)
def test_codec_paths(given, wanted, names):
    assert [c.name for c in path(given, wanted)] == names


def test_no_path_and_own_codecs():
    with pytest.raises(TypeError):
        path(BINARY, INT)
    with pytest.raises(TypeError):
        path(record("struct<a:int>"), BINARY)
    own = Codec("own", BINARY, INT, lambda v: F.octet_length(v))
    assert path(STRING, INT, [*DEFAULT, own])[-1].name == "own"
    assert ANY.ddl is None


def test_spread_really_spreads(spark):
    assert Flow(spark).source(Items(list("abcdefgh"))).spread(3).frame().rdd.getNumPartitions() == 3


def test_branches_both_get_everything(spark):
    step = numbers(spark, 4)
    assert values(step.map(lambda v: v + 1)) == [2, 3, 4, 5]
    assert values(step.map(lambda v: -v)) == [-1, -2, -3, -4]


def long_word(v: int) -> bool:
    return v > 1


class Even(Mapper):
    takes, gives = LONG, PYTHON[bool]

    def prepare(self):
        return lambda v: v % 2 == 0


def sizes(batches):
    for pdf in batches:
        yield pdf.assign(k1=0, value=len(pdf))[["k0", "k1", "ts", "value"]]


def test_options_take_effect(spark):
    tasks = lambda step: step.frame().rdd.getNumPartitions()
    assert tasks(numbers(spark, 9, 8).map(lambda_add).par(3)) == 3 and tasks(numbers(spark, 9, 8).filter(long_word).par(2)) == 2
    assert tasks(numbers(spark, 9, 8).map(lambda v: v + 1).par(3)) == 8
    assert tasks(numbers(spark, 9, 8).throttle(1000, 1.0)) == 1
    assert values(numbers(spark, 5).process(sizes, LONG).buffer(2)) == [2, 2, 2, 2, 1] and values(numbers(spark, 5).process(sizes, LONG)) == [5] * 5
    assert values(numbers(spark, 5).filter(Even())) == [2, 4]
    with pytest.raises(TypeError):
        numbers(spark, 5).filter(Prefix())
    with pytest.raises(ValueError):
        numbers(spark, 5).buffer(0)
    with pytest.raises(ValueError):
        numbers(spark, 5).throttle(0, 1.0)


def lambda_add(v: int) -> int:
    return v + 1


def test_folds_in_stretches(spark, monkeypatch):
    from brookline.operators import numbering

    monkeypatch.setattr(numbering, "STRETCH", 3)
    want = [sum(range(1, i + 1)) for i in range(1, 26) if i % 2 == 0 or i == 25]
    assert values(numbers(spark, 25, 4).fold(Fold("sum", lambda v: v)).each(2)) == want
    assert values(numbers(spark, 25, 4).fold(Fold("min", lambda v: 9 - v, None)).each(6)) == [3, -3, -9, -15, -16]
    assert values(numbers(spark, 8, 4).fold(Fold("max", lambda v: F.when(v > 5, v), None)).each(2)) == [None, None, 6, 8]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30), st.integers(1, 7))
def test_fold_is_pythons_left_fold(spark, xs, each):
    df = spark.createDataFrame(list(enumerate(xs)), "k bigint, v bigint").repartition(3)
    got = values(Flow(spark).table(df, "k", "v", LONG).fold(Fold("sum", lambda v: v, 5)).each(each))
    assert got == [5 + sum(xs[:i]) for i in range(1, len(xs) + 1) if i % each == 0 or i == len(xs)]
