"""Queries against SQL, sinks and streams."""

import hashlib
import logging
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis import catalog
from tamis.operators import Each, Fields, Int, Lookup, Max, Unicode, iterate
from tamis.plans.runner import Runner, apply, assert_step
from tamis.sources.tables import log, read, write
from tamis.streaming.quarantine import clean, quarantine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("name", ["ref_base64", "ref_bytearray"])
def test_whole_texts(spark, tmp_path, name):
    """What stands behind the first 30 or 40 characters counts."""
    texts = {1: "a" * 45 + "é", 2: "a" * 45 + "я", 3: "b" * 5000 + "漢", 4: "", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.cleaned, r.codes) for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    if name == "ref_base64":
        assert got == {i: (None if t is None else hashlib.md5(t.encode()).hexdigest(), "") for i, t in texts.items()}
    else:
        assert got == {1: (46, ""), 2: (None, ":bad_encoding"), 3: (None, ":bad_encoding"), 4: (0, ""), 6: (None, "")}


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_predicates_reach_the_scan(spark):
    out = catalog.queries()["ref_max"](spark, DATA).where("id > 5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Pushed\w+: \[IsNotNull\(event_id\), GreaterThan\(event_id,5\)\]", plan)
    assert "Exchange" not in plan and "props" not in plan.split("ReadSchema")[1]


def test_sinks(spark, tmp_path, caplog):
    df = spark.createDataFrame([(1, "1"), (2, "x")], "i int, v string")
    r = Runner(Int, df, "v")
    write(r, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert [x.i for x in read(spark, f"{tmp_path}/good").collect()] == [1]
    assert [(x.i, x.code) for x in read(spark, f"{tmp_path}/bad").collect()] == [(2, "not_numeric")]
    with caplog.at_level(logging.ERROR):
        assert log(r, logging.getLogger("t")).count() == 2
    assert "not_numeric" in caplog.text


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "1"), (2, "x"), (3, "é")], "i int, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i int, v string").parquet(f"{tmp_path}/in")
    assert clean(stream, "v", Unicode).isStreaming
    quarantine(stream, "v", Int, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.i for r in spark.read.parquet(f"{tmp_path}/good").collect()] == [1]
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == [2, 3]


def test_lookup(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, v string")
    rows = apply(df, "v", Lookup(table, "k")).orderBy("i").collect()
    assert rows[0].cleaned.n == 1 and [i.code for i in rows[1].issues] == ["not_found"] and rows[2].is_valid


def test_iterate(spark):
    df = spark.createDataFrame([(1, ["3", "x"])], "i int, v array<string>")
    assert [(r.pos, r.value, len(r.issues)) for r in iterate(df, "v", Int).orderBy("pos").collect()] == [(0, 3, 0), (1, None, 1)]


def test_iterate_fields(spark):
    df = spark.createDataFrame([(1, {"a": "x", "z": "9", "b": "8"}), (2, None)], "i int, v map<string,string>")
    rows = [(r.key, None if r.value is None else r.value.toPython(), [i.code for i in r.issues]) for r in iterate(df, "v", Fields({"c": None, "a": Int}, False, ["b"])).collect()]
    assert rows == [("c", None, ["missing"]), ("a", None, ["not_numeric"]), ("b", "8", [])]
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',)], "t string").select(F.parse_json("t").alias("v"))
    assert [(r.key, len(r.issues)) for r in iterate(df, "v", Each(Int, of="map")).orderBy("key").collect()] == [("a", 0), ("b", 1)]
    df = spark.createDataFrame([((3, "x"),)], "v struct<n:int,m:string>")
    assert [(r.key, r.value.toPython()) for r in iterate(df, "v", Fields({"n": Max(5)})).collect()] == [("n", 3), ("m", "x")]
    with pytest.raises(TypeError):
        iterate(df, "v", Int)


def test_helper(spark):
    df = spark.createDataFrame([(3, 3, [])], "v int, want int, codes array<string>")
    assert_step(Max(5), df, "v", "want", "codes")
    with pytest.raises(AssertionError):
        assert_step(Max(1), df, "v", "want", "codes")


def test_empty_table(spark):
    df = spark.createDataFrame([], "v string")
    assert apply(df, "v", Int).collect() == []
    assert apply(df.withColumn("_x", F.lit(1)), "v", Unicode).collect() == []
