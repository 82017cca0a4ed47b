"""Versions, transactions, the shell and the profiler."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import exprs as E
from quern.operators import dml
from quern.plans.profile import Profiler
from quern.queries import QUERIES
from quern.shell import Shell
from quern.sources.store import Conflict, Store, write_clustered


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/t", sort_by=("id",))
    s.write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    return s


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, store):
    assert store.append(spark.createDataFrame([(3, "c")], "id long, name string")) == 2
    assert ids(store.read()) == [1, 2, 3] and ids(store.read(1)) == [1, 2]
    with pytest.raises(Conflict):
        store.write(store.read(), after=1)
    assert store.rollback(1) == 3 and ids(store.read()) == [1, 2]
    store.vacuum()
    assert [n for n, _ in store.versions()] == [3] and ids(store.read()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        store.read(1)


def test_transactions(store):
    with store.transaction() as t:
        t.apply(lambda df: dml.delete_many(df, F.col("id") == 1))
        t.savepoint("p")
        t.apply(lambda df: df.where("false"))
        t.rollback_to("p")
    assert ids(store.read()) == [2] and store.version() == 2
    with pytest.raises(ValueError), store.transaction() as t:
        t.apply(lambda df: df.where("false"))
        raise ValueError
    assert ids(store.read()) == [2]


def test_shell(spark, store, tmp_path):
    sh = Shell(spark)
    sh.mount("t", store.path)
    assert sh.run("list") == "t" and sh.run("count") == "2" and "name\tstring" in sh.run("schema")
    assert sh.run("query id >= 1 sort id desc --ndjson").splitlines()[0] == '{"id":2,"name":"b"}'
    assert sh.run('insert {"id": 9, "name": "z y"}') == "version 2"
    assert sh.run("fetch 9") == '{"id":9,"name":"z y"}'
    sh.run('update 9 {"name": "q"}')
    sh.run("begin")
    sh.run("delete 1")
    assert sh.run("count") == "2"
    sh.run("rollback")
    assert sh.run("count") == "3"
    sh.run("softDelete 2")
    assert json.loads(sh.run("fetchAll --json")) == [{"id": 1, "name": "a", "isDeleted": False}, {"id": 9, "name": "q", "isDeleted": False}] or sh.run("count") == "2"
    assert "Filter" in sh.run("explain query id = 1")
    sh.run(f"dump {tmp_path}/d")
    assert sh.run(f"verify {tmp_path}/d") == "ok" and sh.run(f"restore u {tmp_path}/d") == "u"
    with pytest.raises(ValueError):
        sh.run("fly")


def test_layout_and_profile(spark, store, tmp_path):
    write_clustered(spark.range(100), f"{tmp_path}/c", ["id"], files=4)
    df = spark.read.parquet(f"{tmp_path}/c").where("id > 90")
    p = Profiler(slow_seconds=0.0)
    assert len(p.rows("a", df)) == 9 and len(p.rows("b", df)) == 9
    assert p.statistics()["count"] == 2 and p.slow()[0][2] == 9 and p.advice() == ["id"]


def test_clustered_files_go_by_rows(spark, tmp_path, monkeypatch):
    """No file, and so no task, has many more rows than another as the table grows, even if one value has most of the rows."""
    monkeypatch.setattr("quern.sources.store.FILE_ROWS", 1000, raising=False)
    spark.range(10_000).selectExpr("id", "id % 7 AS n").write.parquet(f"{tmp_path}/even")
    spark.range(10_000).selectExpr("if(id < 9000, 5, id) AS id", "id AS n", "map(id, id) AS m").write.parquet(f"{tmp_path}/common")
    for name in ("even", "common"):
        df = spark.read.parquet(f"{tmp_path}/{name}")
        write_clustered(df, f"{tmp_path}/{name}-c", ["id"])
        out = spark.read.parquet(f"{tmp_path}/{name}-c")
        assert sorted(out.select("id", "n").collect()) == sorted(df.select("id", "n").collect())
        files = sorted((r["low"], r["high"], r["rows"]) for r in out.groupBy(F.input_file_name()).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("rows")).collect())
        assert len(files) == 10 and max(f[2] for f in files) < 2500
        assert all(a[1] <= b[0] for a, b in zip(files, files[1:]))
    write_clustered(spark.range(0), f"{tmp_path}/none", ["id"])
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_clustered_lookup_by_size(spark, tmp_path, monkeypatch):
    """The query's files too go by the rows."""
    monkeypatch.setattr("quern.sources.store.FILE_ROWS", 1000, raising=False)
    spark.range(8000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id % 200 AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["clustered_lookup"](spark, str(tmp_path))
    assert len(out.inputFiles()) == 8 and sorted(r["l_orderkey"] for r in out.collect()) == [i for i in range(8000) if 20 <= i % 200 <= 40]


def test_times_as_numbers(spark):
    row = spark.sql("select timestamp_ntz'2001-01-01 00:00:10' t, 10.0d n, 2 b").select(E.seconds_since_2001("t").alias("s"), E.same_time("t", E.time_since_2001("n")).alias("e"), E.truth("b").alias("b")).first()
    assert tuple(row) == (10.0, True, True)
