"""Literal fixtures: missing values, ties, empty inputs, zero divisors, errors."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from quern import catalog
from quern.functions import exprs as E
from quern.functions import geo, predicates, search, vector
from quern.operators import aggregates, constraints, dml, joins, ordering, setops, subquery
from quern.operators.series import Series
from quern.operators.windows import moving
from quern.plans import explain, parse, policy
from quern.query import InvalidQuery, Query
from quern.sources import io
from quern.streaming import live


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "a", None, 5), (2, "b", "archived", 1), (3, "c", "active", None), (4, None, "active", 5)], "id long, name string, status string, priority long")


def test_missing_policy(people):
    q = Query(people)
    assert sorted(values(q.where("status", not_equals="archived").to_df(), "id")) == [1, 3, 4]
    assert values(q.where("status", equals="archived").to_df(), "id") == [2]
    assert sorted(values(q.where("status", not_like="act%").to_df(), "id")) == [1, 2]
    assert values(q.where_missing("status").to_df(), "id") == [1]
    assert sorted(values(q.where_any(F.col("status") == "archived", F.col("priority") > 4).to_df(), "id")) == [1, 2, 4]
    assert q.where("status", among=[]).rows() == 0
    with pytest.raises(InvalidQuery):
        q.where("status", resembles="x")


def test_order_puts_missing_last_both_ways(people):
    assert values(Query(people).order_by("priority", "id").to_df(), "id") == [2, 1, 4, 3]
    assert values(Query(people).order_by("-priority", "id").to_df(), "id") == [1, 4, 2, 3]
    assert values(Query(people).order_by("id").page(2, 3).to_df(), "id") == [4]
    assert Query(people).limit(-1).rows() == 0
    with pytest.raises(InvalidQuery):
        Query(people).page(0)


def test_aggregates_over_nothing(people):
    row = Query(people).where("id", greater_than=9).count().sum("priority").avg("priority").max("priority").to_df().first()
    assert (row["count"], row["sum_priority"], row["avg_priority"], row["max_priority"]) == (0, 0.0, 0.0, None)
    groups = {r["status"]: r["n"] for r in Query(people).group_by("status").count("n").to_df().collect()}
    assert groups == {None: 1, "archived": 1, "active": 2}
    with pytest.raises(InvalidQuery):
        Query(people).group_by("status").to_df()
    assert sorted(values(aggregates.distinct(people, "status"), "status")) == ["active", "archived"]


def test_arithmetic_never_fails(spark):
    df = spark.createDataFrame([(100.0, 4, -5.5), (1.0, 0, 9.0), (7.0, None, None)], "a double, b long, c double")
    got = df.select(E.divide("a", "b").alias("d"), E.modulo(F.col("a").cast("long"), "b").alias("m"), E.round_("c").alias("r"), E.sqrt("c").alias("s"), E.larger("a", "b").alias("g"), E.smaller("a", "b").alias("l")).collect()
    assert [tuple(r) for r in got] == [(25.0, 0, -6.0, 0.0, 100.0, 4.0), (0.0, 0, 9.0, 3.0, 1.0, 0.0), (None, None, None, None, None, None)]
    assert values(df.select(E.case([(F.col("b") > 1, "x")]).alias("v")), "v") == ["x", None, None]
    with pytest.raises(ValueError):
        E.case([])
    with pytest.raises(ValueError):
        E.time_bin("a", "minute")


def test_windows(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([10, 20, 20, 30, 30, 30, 40])], "id long, score long")
    got = Query(df).window("rank", "r", ["score"]).window("dense_rank", "d", ["score"]).window("sum", "s", ["id"], field="score").order_by("id").to_df()
    assert values(got, "r") == [1, 2, 2, 4, 4, 4, 7]
    assert values(got, "d") == [1, 2, 2, 3, 3, 3, 4]
    assert values(got, "s") == [10.0, 30.0, 50.0, 80.0, 110.0, 140.0, 180.0]


def test_moving_window_follows_x(spark):
    df = spark.createDataFrame([(4, 16.0), (0, 1.0), (6, 64.0), (2, 4.0), (7, 128.0), (1, 2.0), (5, 32.0), (3, 8.0)], "x long, y double")
    assert values(moving(df, "x", "y", 3, "sum", "m").orderBy("x"), "m") == [1, 3, 7, 14, 28, 56, 112, 224]
    day = dt.datetime(2026, 3, 1, 12)
    e = spark.createDataFrame([(day + dt.timedelta(days=i), float(2**i)) for i in (3, 0, 2, 1)], "t timestamp_ntz, v double")
    s = Series(e).x("t", "day").y("sum", "v").moving_average(2).sorted(False)
    assert [y for _, y in s.points()] == [6.0, 3.0, 1.5, 1.0]
    with pytest.raises(ValueError):
        Series(e).x("t").to_df()
    assert Series(e.where("v < 0")).x("t", "day").y("count").points() == []


def test_joins(spark):
    users = spark.createDataFrame([("1", "Ann"), ("2", "Bo")], "id string, name string")
    bugs = spark.createDataFrame([("b1", "x", "1"), ("b2", "y", "1"), ("b3", "z", "9"), ("b4", "w", None)], "id string, title string, author_id string")
    counts = {k: joins.join(bugs, users, "author_id", "id", k).count() for k in joins.KINDS}
    assert counts == {"inner": 2, "left": 4, "right": 3, "full": 5, "semi": 2, "anti": 2}
    merged = joins.join(bugs, users, "author_id", "id", "right").where("name = 'Bo'").first()
    assert (merged["id"], merged["title"]) == ("2", None)
    both = joins.pairs(bugs, users, "author_id", "id", "full")
    assert (joins.complete(both).count(), joins.incomplete(both).count()) == (2, 3)
    assert tuple(joins.statistics(both).first()) == (5, 2, 2, 1)


def test_set_operations(spark):
    a = spark.createDataFrame([(1, "a1"), (2, "a2"), (None, "a0")], "id long, v string")
    b = spark.createDataFrame([(2, "b2", 1), (3, "b3", 2)], "id long, v string, w long")
    assert sorted(values(setops.union(a, b), "id", "v")) == [(1, "a1"), (2, "a2"), (3, "b3")]
    assert setops.union_all(a, b).count() == 5
    assert values(setops.intersect(a, b), "v") == ["a2"]
    assert values(setops.except_(a, b), "v") == ["a1"]
    assert values(Query(a).order_by("-id").limit(1).union(b).order_by("id").to_df(), "v") == ["a2", "b3"]


def test_subqueries(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "id long, k long")
    sub = spark.createDataFrame([(5,), (None,)], "k long")
    assert values(subquery.in_subquery(df, "k", sub, "k"), "id") == [1]
    assert values(subquery.not_in_subquery(df, "k", sub, "k"), "id") == [2]
    assert sorted(values(subquery.not_in_subquery(df, "k", sub, "k", True), "id")) == [2, 3]
    assert subquery.exists(df, sub).count() == 3 and subquery.exists(df, sub.where("k > 9")).count() == 0
    assert subquery.not_exists(df, sub).count() == 0
    assert values(subquery.correlated(df, "k", "greater", df, "id", "id", F.avg("k") - 1), "id") == [1, 2]


def test_search(spark):
    df = spark.createDataFrame([(1, "Login bug", "It fails"), (2, "Signup issue", None), (3, "Login button color", "login login")], "id long, title string, description string")
    got = {r["id"]: r["score"] for r in search.scan_search(df, "login", ["title", "description"]).collect()}
    assert got == {1: 15.0, 3: 45.0}
    assert search.scan_search(df, "", ["title"]).count() == 0
    assert {r["id"]: r["score"] for r in search.index_search(search.postings(df, "id", ["title", "description"]), "id", "login").collect()} == {1: 22.5, 3: 42.0}
    assert values(search.advanced_search(df, "xxxxxxxx", ["title"], stemming=False, fuzzy=True, snippets=True), "id") == []
    fuzzy = search.advanced_search(df, "Logon", ["title"], stemming=False, fuzzy=True, snippets=True)
    assert sorted(values(fuzzy, "id", "score")) == [(1, 0.5), (3, 0.5)]
    assert values(search.advanced_search(df, '"button c"', ["title"]), "id", "score") == [(3, 10.0)]
    assert [search.stem_word(w) for w in ("running", "cats", "bed", "nations", "LY")] == ["runn", "cat", "bed", "nation", "ly"]
    assert values(df.where("id = 1").select(search.highlight(F.col("title"), ["login"]).alias("h")), "h") == ["<mark>Login</mark> bug"]


def test_vectors_and_places(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0]), (5, None)], "id long, e array<float>")
    got = dict(values(vector.nearest(df, "e", [1.0, 0.0]), "id", "similarity"))
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: pytest.approx(0.70710678), 5: 0.0}
    packed = spark.createDataFrame([(bytearray(struct.pack("<4f", 0.1, -2.5, 0.0, 1e30)),)], "b binary")
    assert values(packed.select(io.unpack_floats(F.col("b"), 4).alias("v")), "v")[0] == pytest.approx([0.1, -2.5, 0.0, 1e30], rel=1e-6)
    places = spark.createDataFrame([("sf", 37.7749, -122.4194), ("oak", 37.8044, -122.2711), ("none", None, None)], "n string, latitude double, longitude double")
    d = dict(values(geo.nearest(places, "latitude", "longitude", 37.7749, -122.4194), "n", "distance"))
    assert d["sf"] == 0 and 10_000 < d["oak"] < 20_000 and d["none"] is None
    assert values(Query(places).within_radius(37.77, -122.42, 2000).to_df(), "n") == ["sf"]


def test_grammar(spark, people):
    q = parse.parse("query priority >= 1 and status != 'archived' sort priority desc limit 5 offset 0 --json")
    assert q.filters == (("priority", ">=", 1), ("status", "!=", "archived")) and (q.sort, q.limit, q.offset, q.output) == (("priority", True), 5, 0, "json")
    assert sorted(values(q.query(people).to_df(), "id")) == [1, 4]
    assert parse.parse("a>=2.5").filters == (("a", ">=", 2.5),)
    assert [parse.literal(x) for x in ("null", "true", "7", "1.5", "x")] == [None, True, 7, 1.5, "x"]
    for bad in ("", "sort a", "a ?? 3", "a = 1 b = 2", "a = 1 limit x", "a = 'x"):
        with pytest.raises(parse.ParseError):
            parse.parse(bad)
    assert values(parse.from_json(people, '{"filters": [{"field": "status", "op": "nil"}], "project": ["id"]}').to_df(), "id") == [1]
    assert parse.shown(people.where("id = 2").select("id", "status"), "ndjson") == '{"id":2,"status":"archived"}'
    with pytest.raises(parse.ParseError):
        parse.condition({"field": "a", "op": "near"})


def test_policies(people):
    rules = policy.Policies().add(policy.owner("name"), policy.Policy("young", lambda _: F.col("priority") < 5, True))
    assert rules.condition("select", {"id": "b"}) is not None and policy.Policies().condition("select", {}) is None
    assert values(Query(people, rules.condition("select", {"id": "b"})).to_df(), "id") == [2]
    assert Query(people, policy.Policies(policy.PRESETS["authenticated"]()).condition("select", {})).rows() == 0
    assert Query(people, policy.Policies(policy.PRESETS["viewer_read_only"]()).condition("update", {"roles": ["viewer"]})).rows() == 0
    assert Query(people, policy.Policies(policy.PRESETS["admin_and_team"]()).condition("select", {"roles": ["admin"]})).rows() == 4


def test_changes(spark, people):
    up = dml.update_many(people, F.col("status") == "active", {"status": "done", "priority": F.col("priority") + 1, "flag": True}, now="2025-01-02")
    assert sorted(values(up, "id", "status", "priority", "flag")) == sorted([(1, None, 5, None), (2, "archived", 1, None), (3, "done", None, True), (4, "done", 6, True)], key=lambda r: r[0])
    gone = dml.soft_delete(people, F.col("id") == 1)
    assert Query(gone).rows() == 3 and gone.count() == 4 and dml.purge(gone).count() == 3
    new = spark.createDataFrame([(2, "B"), (9, "Z")], "id long, name string")
    assert sorted(values(dml.upsert(people, new), "id", "name"), key=lambda r: r[0]) == [(1, "a"), (2, "B"), (3, "c"), (4, None), (9, "Z")]
    assert sorted(values(dml.upsert_report(people, new), "id", "inserted")) == [(2, False), (9, True)]
    assert sorted(values(dml.delete_many(people, F.col("priority") > 1), "id")) == [2, 3]
    assert sorted(values(dml.update_ids(people, new, {"status": "x"}), "id", "status"), key=lambda r: r[0])[1] == (2, "x")
    assert sorted(values(dml.delete_ids(people, new), "id")) == [1, 3, 4]
    added = dml.insert(people.withColumn("id", F.col("id").cast("string")), spark.createDataFrame([("q",)], "name string"), now="2025-01-01", project="p")
    assert len(added.where("name = 'q'").first()["id"]) == 36


def test_constraints(people):
    schema = constraints.Schema((constraints.Field("status", "string", required=True), constraints.Field("name", "long")), strict=True)
    got = sorted(values(schema.violations(people, "id"), "id", "field", "problem"))
    assert got == [(1, "name", "type"), (1, "priority", "unknown"), (1, "status", "missing"), (2, "name", "type"), (2, "priority", "unknown"), (3, "name", "type"), (4, "priority", "unknown")]
    assert values(constraints.check(people, F.col("priority") > 1), "id") == [2]
    assert values(constraints.unique(people, ["status"]), "status", "n") == [("active", 2)]
    assert values(constraints.require(people, "name"), "id") == [4]
    steps = [constraints.Migration(1, lambda d: d.withColumn("x", F.lit(1)), lambda d: d.drop("x")), constraints.Migration(2, lambda d: d.withColumn("y", F.lit(2)))]
    assert {"x", "y"} <= set(constraints.migrate(people, steps, 0, 2).columns)
    with pytest.raises(ValueError):
        constraints.migrate(people, steps, 2, 0)
    seen = []
    constraints.Triggers({"insert": (lambda d: d.where("id > 2"),)}, {"insert": (lambda d: seen.append(d.count()),)}).write("insert", people, lambda d: None)
    assert seen == [2]


def test_ordering(spark):
    df = ordering.enable(spark.createDataFrame([(i,) for i in range(4)], "id long"), ["id"])
    order = lambda d: values(ordering.in_order(d), "id")
    assert order(ordering.move_before(df, "id", 3, 1)) == [0, 3, 1, 2]
    assert order(ordering.move_after(df, "id", 0, 3)) == [1, 2, 3, 0]
    assert order(ordering.move_to(df, "id", 3, 0)) == [3, 0, 1, 2]
    assert order(ordering.move_to(df, "id", 0, 99)) == [1, 2, 3, 0]
    assert order(ordering.move_up(df, "id", 2)) == [0, 2, 1, 3]
    assert order(ordering.move_down(df, "id", 3)) == [0, 1, 2, 3]
    assert (ordering.between(None, None), ordering.between(1.0, 1.0)) == (1000.0, 1.1)


def test_catalog(spark, people):
    c = catalog.Catalog(spark)
    c.mount("people", dml.soft_delete(people, F.col("id") == 1))
    assert c.sql("select count(*) n from people").first()["n"] == 3 and c.query().rows() == 3
    assert c.cached(people) is c.cached(people)
    c.clear()
    assert values(catalog.get_ordered(people, [3, 8, 1]), "id", "name") == [(3, "c"), (8, None), (1, "a")]
    with pytest.raises(ValueError):
        catalog.page(people, -1, 2)
    c.unmount("people")
    assert c.current is None


def test_sources(spark, people, tmp_path):
    io.write_dump(people, f"{tmp_path}/d", name="people")
    assert io.verify_dump(spark, f"{tmp_path}/d") and io.restore_dump(spark, f"{tmp_path}/d").count() == 4
    spark.read.parquet(f"{tmp_path}/d/records").limit(3).write.parquet(f"{tmp_path}/less")
    spark.read.parquet(f"{tmp_path}/less").write.mode("overwrite").parquet(f"{tmp_path}/d/records")
    with pytest.raises(ValueError):
        io.restore_dump(spark, f"{tmp_path}/d")
    (tmp_path / "x.csv").write_text('n,when,ok\n1,2025-01-02,true\n2,2025-01-03,false\n')
    assert dict(io.import_csv(spark, f"{tmp_path}/x.csv").dtypes) == {"n": "int", "when": "date", "ok": "boolean"}
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": null, "b": [2]}]')
    assert io.import_json(spark, f"{tmp_path}/x.json").count() == 2
    assert values(io.as_csv(spark.createDataFrame([('a"b', None)], "x string, y string"), ["x", "y"]), "csv") == ['"a""b",']
    assert io.seeded(spark, 50, 3).exceptAll(io.seeded(spark, 50, 3)).count() == 0
    kv = spark.createDataFrame([("a", bytearray(b"1"))], "key string, value binary")
    kv = io.kv_put(kv, spark.createDataFrame([("a", bytearray(b"2")), ("b", bytearray(b"3"))], kv.schema))
    assert (io.kv_get(kv, "a"), io.kv_get(kv, "z"), io.kv_delete(kv, "a").count()) == (b"2", None, 1)
    (tmp_path / "t.json").write_text('{"header": {}, "records": [{"storage": {"id": {"uuid": "u1"}, "age": {"int": 3}, "name": {"string": "A"}}}]}')
    assert values(io.restore_tagged(spark, f"{tmp_path}/t.json", {"id": "string", "age": "int"}), "id", "age") == [("u1", 3)]
    docs = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "y"}',)], "j string")
    assert dict(values(io.inferred_types(docs, "j"), "field", "type")) == {"a": "mixed", "b": "string"}


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/src"
    t = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("update", "1", "c", t), ("delete", "2", "c", t)], live.CHANGES).write.parquet(src)
    got = []
    live.observe(live.filtered(live.change_feed(spark, src), F.col("id") == "9"), lambda df, n: got.extend(values(df, "id")), f"{tmp_path}/cp", None).awaitTermination()
    assert got == ["2"]
    log = spark.createDataFrame([("a", 1, "n", "o1", "update", 5), ("a", 2, "n", "o2", "update", 6), ("b", 1, "n", "o3", "update", 1), ("b", 3, "m", "o4", "delete", 0)], "id string, counter long, node string, op_id string, change_type string, v long")
    assert values(live.current(log), "id", "v") == [("a", 6)]
    assert sorted(values(live.since(log, 1, "n"), "op_id")) == ["o2", "o4"]


def test_explain(people):
    assert "Filter" in Query(people).where("id", equals=1).explain()
    assert explain.summary(people.groupBy("id").count())["exchanges"] == 1
    assert explain.warnings(people.crossJoin(people.select(F.col("id").alias("x"))))
    with pytest.raises(ValueError):
        explain.explain(people, "none")


def test_predicates(spark):
    df = spark.createDataFrame([(b"ab", dt.datetime(2025, 1, 5)), (b"a" * 100, dt.datetime(2025, 1, 1))], "b binary, t timestamp_ntz")
    assert df.where(predicates.binary_longer("b", 2)).count() == 1
    assert df.where(predicates.recent("t", 3, "2025-01-06")).count() == 1
    assert df.where(predicates.within("t")).count() == 2
