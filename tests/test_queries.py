"""The driver's contract: queries against DuckDB at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from brookline.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(pdf):
    return sorted(map(str, pdf[sorted(pdf.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, D).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(db.sql(sql).df())
    else:
        assert len(got)


def test_registry_ids_of_more_than_four_bytes(spark, tmp_path):
    """Part keys from 32768 on have ids beyond 32 bits."""
    keys = [1, 32767, 32768, 120_000, 7_200_000, 10**12, -1, -40_000]
    spark.createDataFrame([(k, None if k == 1 else f"part {k}") for k in keys], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    own = duckdb.connect()
    own.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = entry.queries()["registry_frame_parse"](spark, str(tmp_path)).toPandas()
    assert len(got) == len(keys) and rows(got) == rows(own.sql(catalog.oracle_sql()["registry_frame_parse"]).df())


@pytest.mark.parametrize("name", ["sink_flush_end", "sink_flush_each"])
def test_no_element_of_a_flush_reaches_the_driver(spark, db, monkeypatch, name):
    """Counts of the statement come from the tasks; nothing but the ranges' bounds and numbers is collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    with monkeypatch.context() as m:
        for way in ("collect", "toLocalIterator", "toPandas", "toArrow", "take", "foreach"):
            m.setattr(DataFrame, way, lambda *_, **__: pytest.fail("rows were sent to the driver"))
        out = entry.queries()[name](spark, D)
    assert rows(out.toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["sink_flush_end", "sink_flush_each"])
def test_flushes_of_no_orders(spark, tmp_path, name):
    spark.read.parquet(f"{D}/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    own = duckdb.connect()
    own.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(own.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["filter_expr"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan.replace("ts:timestamp_ntz,", "")
