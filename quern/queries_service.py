"""Registered queries over what surrounds the query builder: catalog, stores, imports, policies, triggers, feeds, the shell."""

from __future__ import annotations

import itertools
import os
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import catalog
from quern.functions import geo, predicates, search
from quern.operators import constraints, dml, subquery
from quern.operators.series import Series
from quern.plans import explain, parse, policy
from quern.plans.profile import Profiler
from quern.queries import DL, PLACES, TOK, _labelled, _places, query
from quern.query import InvalidQuery, Query
from quern.session import scratch
from quern.shell import Shell
from quern.sources import io
from quern.sources.store import Store, write_clustered
from quern.streaming import live


def rows_of(t, schema: str, *rows: tuple) -> DataFrame:
    """A few rows that are known on the driver."""
    return t.spark.createDataFrame(list(rows), schema)


# catalogue and lookups


@query("SELECT p_partkey, p_brand AS project FROM part WHERE p_brand = 'Brand#11'")
def by_project(t):
    return catalog.by_project(t.part.select("p_partkey", F.col("p_brand").alias("project")), "Brand#11")


@query("SELECT o_orderkey FROM orders")
def all_ids(t):
    return catalog.ids(t.orders, "o_orderkey")


@query("SELECT event_id, event_type, user_id FROM events WHERE lower(event_type) = 'click' AND event_id::VARCHAR = '17' UNION ALL SELECT event_id, event_type, user_id FROM events WHERE lower(event_type) = 'view' AND event_id::VARCHAR = '40'")
def key_lookup(t):
    e = t.events.select("event_id", "event_type", "user_id")
    return catalog.key_lookup(e, "CLICK:17", "event_type", "event_id").unionAll(catalog.key_lookup(e, "view:40", "event_type", "event_id"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def catalog_switch(t):
    c = catalog.Catalog(t.spark)
    c.mount("service_orders", f"{t.folder}/orders.parquet")
    c.mount("service_customers", t.customer)
    c.use("service_customers")
    joined = c.query().join(c.query("service_orders"), "c_custkey", "o_custkey").group_by("c_mktsegment").count("n").to_df()
    c.unmount("service_orders")
    c.unmount("service_customers")
    return joined


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 0")
def lazy_take(t):
    q = t.q("part").project("p_partkey", "p_name").order_by("p_partkey")
    return t.spark.createDataFrame(list(itertools.islice(q.lazy(), 30)), q.to_df().schema)


@query("SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 64)::BIGINT AS batch, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def batches(t):
    return t.q("orders").where("o_orderstatus", equals="O").in_batches(64, "o_orderkey").select("batch", "o_orderkey", "o_totalprice")


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS w FROM events")
def win_whole_table(t):
    return t.q("events").window("row_number", "w", ["-value", "event_id"]).project("event_id", "w")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_zero(t):
    return t.q("orders").order_by("o_orderkey").page_from_zero(2, 20)


@query("SELECT min(o_orderkey) AS first_key, TRUE AS some, FALSE AS none FROM orders WHERE o_orderpriority = '1-URGENT'")
def first_and_exists(t):
    q = t.q("orders").where("o_orderpriority", equals="1-URGENT").order_by("o_orderkey")
    return rows_of(t, "first_key long, some boolean, none boolean", (q.first()["o_orderkey"], q.exists(), q.where("o_totalprice", less_than=0).exists()))


def _error(t, q: Query) -> DataFrame:
    try:
        q.to_df()
    except InvalidQuery as e:
        return rows_of(t, "error string", (str(e),))
    return rows_of(t, "error string")


@query("SELECT 'no field o_totalprise to sort by; did you mean o_totalprice?' AS error")
def sort_suggestion(t):
    return _error(t, t.q("orders").order_by("o_totalprise"))


@query("SELECT 'groupBy needs an aggregate' AS error")
def group_without_aggregate(t):
    return _error(t, t.q("orders").group_by("o_orderpriority"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def cached_result(t):
    c = catalog.Catalog(t.spark)
    df = t.q("orders").group_by("o_orderpriority").count("n").to_df()
    kept = c.cached(df, seconds=3600)
    return c.cached(df, seconds=0) if c.cached(df, seconds=3600) is kept else df


@query("SELECT 'records' AS kind, 5::BIGINT AS n UNION ALL SELECT 'joined', 25 UNION ALL SELECT 'aggregation', 1 UNION ALL SELECT 'grouped', 5 UNION ALL SELECT 'search', 0")
def result_kinds(t):
    nation, region = t.q("nation"), t.q("region")
    asked = [region, nation.join(region, "n_regionkey", "r_regionkey"), nation.count("n"), nation.group_by("n_regionkey").count("n"), region.search("nowhere at all", ["r_name"])]
    results = [q.result() for q in asked]
    return rows_of(t, "kind string, n long", *[(r.kind, r.of(r.kind).count()) for r in results if r.of_or_none("other") is None])


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size <= 12 GROUP BY p_size")
def queries_in_flight(t):
    waiting = [(k, t.q("part").where("p_size", equals=k).later(lambda df: df.count())) for k in range(1, 13)]
    return rows_of(t, "p_size int, n long", *[(k, n) for k, f in waiting if (n := f.result())])


# row functions


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 3 AND p_brand LIKE '%1'")
def where_row_function(t):
    return t.q("part").where_row(lambda r: r["p_size"] % 7 == 3 and r["p_brand"].endswith("1"), "p_size", "p_brand").project("p_partkey", "p_size")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) % 3 = 1 AND sum(o_totalprice) > 1000")
def having_row_function(t):
    q = t.q("orders").group_by("o_custkey").count("n").sum("o_totalprice", "s")
    return q.having(predicates.row_test(lambda r: r["n"] % 3 == 1 and r["s"] > 1000, "n", "s")).project("o_custkey", "n", F.round("s", 2).alias("s"))


@query("SELECT p_partkey, CASE WHEN length(p_name) % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM part")
def case_row_function(t):
    return t.q("part").case_when([(predicates.row_test(lambda r: len(r["p_name"]) % 2 == 0, "p_name"), "even")], "odd", "label").project("p_partkey", "label")


# subqueries over any column

ANY = "(SELECT l_partkey::BIGINT AS v FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)"


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey IN {ANY}")
def in_any_column(t):
    return t.q("orders").where_in("o_orderkey", t.lineitem.where("l_quantity > 49").select("l_partkey", "l_suppkey")).project("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN {ANY}")
def not_in_any_column(t):
    return Query(subquery.not_in_subquery(t.orders, "o_orderkey", t.lineitem.where("l_quantity > 49").select("l_partkey", "l_suppkey"))).project("o_orderkey")


# imports and exports


@query("SELECT r_regionkey, r_name FROM region")
def fixtures(t):
    to = scratch(t.spark)
    io.snapshot(t.region, to)
    return io.restore(t.spark, to, "r_regionkey int, r_name string")


@query("SELECT o_orderkey::BIGINT AS o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day, o_orderpriority FROM orders")
def json_times(t):
    to = scratch(t.spark)
    t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority").write.json(to)
    df = io.import_json(t.spark, to, times=True)
    return df.select("o_orderkey", F.col("day").cast("timestamp_ntz").alias("day"), "o_orderpriority")


@query("SELECT 'x,b' AS line UNION ALL SELECT '3'")
def csv_rejects(t):
    to = scratch(t.spark)
    rows_of(t, "value string", ("1,a",), ("x,b",), ("2,c",), ("3",)).coalesce(1).write.text(to)
    return io.csv_rejects(t.spark, to, "k int, v string", header=False)


def _local_file(t, name: str) -> str:
    folder = scratch(t.spark).removeprefix("file:")
    os.makedirs(folder)
    return f"{folder}/{name}"


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 2 END AS half FROM nation")
def sqlite_import(t):
    path = _local_file(t, "nations.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nations (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INT, half REAL)")
        db.executemany("INSERT INTO nations VALUES (?, ?, ?, ?)", [(r[0], r[1], r[2], r[0] / 2 if r[0] % 2 == 0 else None) for r in t.nation.select("n_nationkey", "n_name", "n_regionkey").collect()])
    return io.import_sqlite(t.spark, path, "nations", batch=7, parts=3)


@query("SELECT 1::BIGINT AS id, 'a' AS name UNION ALL SELECT 3, 'it''s'")
def sqlite_script(t):
    script = "CREATE TABLE x (id INTEGER, name TEXT); INSERT INTO x VALUES (1, 'a'), (2, 'b'), (3, 'c'); DELETE FROM x WHERE id = 2; UPDATE x SET name = 'it''s' WHERE id = 3;"
    return io.import_sqlite_script(t.spark, script, "x", _local_file(t, "script.db"))


@query("SELECT 5000::BIGINT AS n, 3::BIGINT AS statuses, 1::BIGINT AS low, 5::BIGINT AS high, 5000::BIGINT AS titles")
def generated(t):
    return io.seeded(t.spark, 5000, 7).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("status").alias("statuses"), F.min("priority").alias("low"), F.max("priority").alias("high"), F.count_distinct("title").alias("titles"))


@query("SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_nationkey::VARCHAR END AS value FROM nation WHERE n_name <> 'FRANCE'")
def byte_keys(t):
    table = t.nation.select(F.col("n_name").alias("key"), F.encode(F.col("n_nationkey").cast("string"), "utf-8").alias("value"))
    table = io.kv_put(table, t.nation.where("n_regionkey = 1").select(F.col("n_name").alias("key"), F.encode(F.lit("new"), "utf-8").alias("value")))
    return io.kv_delete(table, "FRANCE").select("key", F.decode("value", "utf-8").alias("value"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def ndjson_lines(t):
    return parse.lines(t.region.select("r_regionkey", "r_name"), "ndjson")


@query("SELECT vec_id, list_transform(embedding, lambda x: x::FLOAT) AS vector FROM embeddings")
def packed_vectors(t):
    import pyarrow as pa

    dims = t.embeddings.select(F.size("embedding")).first()[0]

    def packed(batches):
        import numpy as np

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([np.array(v, "<f4").tobytes() for v in b.column("embedding").to_pylist()], pa.binary())], names=["vec_id", "packed"])

    rows = t.embeddings.select("vec_id", "embedding").mapInArrow(packed, "vec_id long, packed binary")
    return rows.select("vec_id", io.unpack_floats(F.col("packed"), dims).alias("vector"))


# stores


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'moved' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 3")
def store_transaction(t):
    store = Store(t.spark, scratch(t.spark), sort_by=("n_nationkey",))
    store.write(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    with store.transaction() as change:
        change.apply(lambda df: dml.delete_many(df, F.col("n_regionkey") == 3))
        change.savepoint("p")
        change.apply(lambda df: df.where("false"))
        change.rollback_to("p")
        change.apply(lambda df: dml.update_many(df, F.col("n_regionkey") == 2, {"n_name": "moved"}))
    return store.read().select("n_nationkey", "n_name")


@query("SELECT 1 AS version, count(*) AS n FROM nation UNION ALL SELECT 2, count(*) FILTER (WHERE n_regionkey <> 0) FROM nation UNION ALL SELECT 3, count(*) FROM nation")
def store_versions(t):
    store = Store(t.spark, scratch(t.spark))
    store.write(t.nation)
    store.change(lambda df: dml.delete_many(df, F.col("n_regionkey") == 0))
    store.rollback(1)
    out = None
    for n, _ in store.versions():
        one = store.read(n).agg(F.lit(n).alias("version"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 0 ELSE p_size END AS p_size FROM part WHERE p_size <= 40")
def bulk_changes(t):
    steps = (lambda df: dml.update_many(df, F.col("p_size") < 20, {"p_size": 0}), lambda df: dml.delete_many(df, F.col("p_size") > 40))
    return dml.bulk(t.part.select("p_partkey", "p_size"), *steps)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 20 AND 40")
def clustered_lookup(t):
    to = scratch(t.spark)
    write_clustered(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), to, ["l_partkey"])
    return Query(t.spark.read.parquet(to)).where_range("l_partkey", 20, 40).project("l_orderkey", "l_linenumber")


# constraints and triggers


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fk_cascade(t):
    return constraints.on_delete(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal < 0"), "c_custkey", "cascade")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fk_restrict(t):
    return constraints.on_delete(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal < 0"), "c_custkey", "restrict")


@query("SELECT 'written' AS kind, upper(r_name) AS name FROM region UNION ALL SELECT 'audit', 'insert of ' || count(*) FROM region")
def triggers(t):
    base = scratch(t.spark)
    audit = lambda rows: rows.agg(F.concat(F.lit("insert of "), F.count(F.lit(1))).alias("name")).write.parquet(f"{base}/audit")
    hooks = constraints.Triggers({"insert": (lambda rows: rows.withColumn("name", F.upper("name")),)}, {"insert": (audit,)})
    hooks.write("insert", t.region.select(F.col("r_name").alias("name")), lambda rows: rows.write.parquet(f"{base}/rows"))
    read = lambda part, kind: t.spark.read.parquet(f"{base}/{part}").select(F.lit(kind).alias("kind"), "name")
    return read("rows", "written").unionAll(read("audit", "audit"))


@query(f"SELECT doc_id FROM {DL} WHERE quality IS NULL OR toxic IS NULL")
def required_fields(t):
    return constraints.require(_labelled(t).to_df(), "quality", "toxic").select("doc_id")


@query("SELECT 1 AS version, 'n_name' AS columns, NULL::BIGINT AS total UNION ALL SELECT 3, 'label', sum(length(n_name) + 1)::BIGINT FROM nation UNION ALL SELECT 2, 'label', NULL")
def migrations(t):
    steps = [
        constraints.Migration(2, lambda df: df.withColumnRenamed("n_name", "label"), lambda df: df.withColumnRenamed("label", "n_name")),
        constraints.Migration(3, lambda df: df.withColumn("size", F.char_length("label") + 1), lambda df: df.drop("size")),
    ]
    first = t.nation.select("n_name")
    third = constraints.migrate(first, steps, 1, 3)
    second, again = constraints.migrate(third, steps, 3, 2), constraints.migrate(third, steps, 3, 1)
    total = third.agg(F.sum("size")).first()[0]
    return rows_of(t, "version int, columns string, total long", (1, again.columns[0], None), (3, third.columns[0], total), (2, ",".join(second.columns), None))


# policies


@query("SELECT preset, operation, share * n AS n FROM (VALUES ('admin_and_owner', 'select', 0), ('admin_and_team', 'select', 1), ('viewer_read_only', 'select', 1), ('viewer_read_only', 'update', 0), ('public_read', 'select', 1), ('authenticated', 'select', 1)) v(preset, operation, share), (SELECT count(*) AS n FROM orders)")
def rls_presets(t):
    users = {"admin_and_owner": {"id": -1}, "admin_and_team": {"roles": ["admin"]}, "viewer_read_only": {"roles": ["viewer"]}, "public_read": {}, "authenticated": {"id": 1}}
    asked = [("admin_and_owner", "select"), ("admin_and_team", "select"), ("viewer_read_only", "select"), ("viewer_read_only", "update"), ("public_read", "select"), ("authenticated", "select")]
    table, out = t.orders.select(F.col("o_custkey").alias("userId"), F.col("o_orderpriority").alias("teamId")), None
    for name, operation in asked:
        allowed = policy.Policies(policy.PRESETS[name]()).condition(operation, users[name])
        one = table.where(allowed).agg(F.lit(name).alias("preset"), F.lit(operation).alias("operation"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT event_type AS x, count(*)::BIGINT AS y FROM events WHERE user_id = 3 GROUP BY event_type")
def series_rls(t):
    rules = policy.Policies([policy.owner("user_id")])
    return Series(t.events).x("event_type").y("count").where(rules.condition("select", {"id": 3})).to_df()


# full-text paths


@query(f"SELECT doc_id, 10.0::DOUBLE AS score FROM (SELECT doc_id, {TOK} AS toks FROM documents) WHERE list_contains(toks, 'scum')")
def search_by_index(t):
    index = search.smart_index(t.documents, "doc_id", ["text"], scratch(t.spark), threshold=1)
    return t.q("documents").search("Scum", index=index).project("doc_id", "score")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'scum')")
def search_below_threshold(t):
    index = search.smart_index(t.documents, "doc_id", ["text"], scratch(t.spark), threshold=1 << 62)
    return t.q("documents").search("scum", ["text"], index=index).project("doc_id")


# places


@query(f"SELECT c_custkey, ((floor((latitude + 90) / 5) * 72 + floor((longitude + 180) / 5)))::BIGINT AS cell FROM {PLACES}")
def geo_cells(t):
    return _places(t).select("c_custkey", geo.cell("latitude", "longitude", 5.0).cast("long").alias("cell"))


# feeds


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS change_type FROM events WHERE event_type IN ('error', 'click')")
def change_feed(t):
    base = scratch(t.spark)
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    t.events.select(kind.alias("change_type"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("collection"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{base}/in")
    feed = live.filtered(live.change_feed(t.spark, f"{base}/in"), F.col("collection") == "click")
    live.observe(feed, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/checkpoint", every=None).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("id", "change_type")


# plans


@query("SELECT TRUE AS pushed, 0 AS python, 0 AS nested_loops, 'p_size' AS advice")
def plan_summary(t):
    q = t.q("part").where("p_size", greater_than=40).project("p_partkey")
    s, p = explain.summary(q.to_df()), Profiler()
    p.rows("once", q.limit(1).to_df())
    p.rows("again", q.limit(1).to_df())
    return rows_of(t, "pushed boolean, python int, nested_loops int, advice string", (s["pushed"], s["python"], s["nested_loops"], ",".join(p.advice())))


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY o_orderpriority")
def hinted_join(t):
    return t.q("orders").join(t.q("customer").where("c_acctbal", greater_than=0).hint("shuffle_hash"), "o_custkey", "c_custkey").group_by("o_orderpriority").count("n")


# shell


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS r_name FROM region WHERE r_regionkey NOT IN (2, 3) UNION ALL SELECT 77, 'added'")
def shell_changes(t):
    path = scratch(t.spark)
    Store(t.spark, path).write(t.region.select("r_regionkey", "r_name"))
    shell = Shell(t.spark, key="r_regionkey")
    shell.mount("service_regions", path)
    for line in ('insert {"r_regionkey": 77, "r_name": "added"}', 'update 1 {"r_name": "renamed"}', "begin", "delete 2", "commit", "begin", "delete 0", "rollback", "softDelete 3"):
        shell.run(line)
    out = dml.visible(shell.table).select("r_regionkey", "r_name")
    shell.run("unmount service_regions")
    return out


@query("SELECT 'list' AS command, 'service_parts' AS output UNION ALL SELECT 'count', count(*)::VARCHAR FROM part UNION ALL SELECT 'policy add --preset viewer_read_only', '2 policies, enabled' UNION ALL SELECT 'query p_size > 0 limit 2 --ndjson', '' UNION ALL SELECT 'policy disable', '2 policies, disabled'")
def shell_answers(t):
    shell = Shell(t.spark, key="p_partkey", user={"roles": ["guest"]})
    shell.mount("service_parts", f"{t.folder}/part.parquet")
    asked = ["list", "count", "policy add --preset viewer_read_only", "query p_size > 0 limit 2 --ndjson", "policy disable"]
    out = rows_of(t, "command string, output string", *[(a, shell.run(a)) for a in asked])
    shell.run("unmount service_parts")
    return out
