"""Results and plans that only large tables would show, on small ones."""

import random

import duckdb
from pyspark.sql import functions as F

from tracelake.operators import rules


def _sent_to_all(df):
    """How many tables the plan sends to all executors."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_only_rules_are_sent_to_all(spark):
    from tracelake.plans import etl as plan

    n = spark.range(1000).select(F.col("id").alias("node"), F.lit("Task").alias("class"))
    v = spark.range(1000).select(F.col("id").alias("node"), F.lit("size").alias("field"), F.lit("x").alias("value"))
    got = rules.fields(n, v, plan._schema(spark))
    assert _sent_to_all(got) <= 4
    assert {(r.field, r.issue): r["count"] for r in got.groupBy("field", "issue").count().collect()} == {("name", "required"): 1000, ("size", "wrong type"): 1000}


def test_branches_of_like_hashes_stay_apart(spark):
    from tracelake.operators import etl

    # The SHA-1 of both names begins with bac083727e.
    e = spark.createDataFrame([("e470742", "a", "b", "default", "pass", None), ("e1254390", "a", "c", "default", "fail", None)], "edge string, src string, dst string, kind string, on string, criteria string")
    c = spark.createDataFrame([(x, "Task", "self") for x in "abc"], "node string, class string, subject string")
    t = etl.downgrade(e, c)
    assert t.where("p = 'type' AND o = 'Branch'").count() == 2
    back = etl.upgrade(t)[0]
    assert sorted((r.src, r.dst, r.on) for r in back.collect()) == [("a", "b", "pass"), ("a", "c", "fail")]


def test_drift_with_parts_of_any_number(spark, tmp_path):
    from tracelake.plans import etl as plan

    rows = [(1, "a", 3), (2, "b", 7), (3, "c", 9), (1_000_001, "d", 1), (1_000_002, "e", 3), (1_000_003, "f", 7)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, plan._drift(spark, str(tmp_path)).collect())) == sorted(con.execute(plan.ORACLE_SQL["etl6_drift"]).fetchall())


def test_views_of_few_and_many_workflows(spark, monkeypatch):
    from tracelake.operators import views

    e = spark.createDataFrame([("a", "k", "b"), ("a", "k", "b"), ("b", "k", "c"), ("c", "k", "d"), ("d", "k", "e"), ("x", "k", "y")], "src string, kind string, dst string")
    m = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "d"), ("2", "d"), ("3", "q")], "workflow string, node string")
    for few in (256, 2):
        monkeypatch.setattr(views, "FEW", few)
        assert sorted((r.workflow, r.src) for r in views.touching(e, m).collect()) == [("1", "a"), ("1", "b"), ("2", "c"), ("2", "d")]
        assert sorted((r.workflow, r.src) for r in views.stream_view(e, m).collect()) == [("1", "a"), ("1", "b"), ("1", "c"), ("2", "b"), ("2", "c"), ("2", "d")]
    monkeypatch.undo()
    assert _sent_to_all(views.stream_view(e, spark.range(1000).select(F.lit("1").alias("workflow"), F.col("id").cast("string").alias("node")))) == 0


def test_gaps_read_uses_once(spark):
    from tracelake.operators import artifacts

    node = F.concat(F.lit("n"), "id")
    folders = spark.range(1000).select(node.alias("node"), F.lit("data/a.png").alias("path"), F.when(F.col("id") % 2 == 0, "output").alias("role"), F.lit(None).cast("string").alias("explicit_type"))
    given = spark.range(1000).select(node.alias("node"), F.concat(F.lit("memo "), "id").alias("text"))
    members = spark.range(1000).select(F.when(F.col("id") < 500, "a").otherwise("b").alias("scope"), node.alias("node"))
    used = artifacts.uses(folders, given, spark.createDataFrame([("n1", "x", "produces")], "src string, dst string, kind string"), members)
    got = artifacts.gap_summary(artifacts.gaps(used))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Broadcast" not in plan
    assert {(r.measure, r.value): r.n for r in got.where("n > 0").collect()} == {("unconsumed", "document"): 1001, ("hint", "terminal/review document candidate"): 1001}


def test_documents_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    from tracelake.operators import documents
    from tracelake.plans import documents as plan

    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(documents, "walk", lambda docs: docs)
    assert plan._walk(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.undo()
    rows = [("d", '{"workflows": [{"id": "w", "nodes": [{"id": "a", "type": "eval", "branches": [null]}, {"id": "b", "type": "eval", "branches": [null, {"on": "x"}]}, {"id": "c"}, 1, [2]]}]}'), ("e", '{"workflows": {"id": "w"}}')]
    nodes = documents.walk(spark.createDataFrame(rows, "doc string, value string"))[1]
    assert sorted(r.src for r in documents.nexts(nodes).collect() if r.dst) == ["node/w/a"]


def test_propagation_makes_its_edges_once(spark, monkeypatch):
    from tracelake.operators import graph

    kept, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, **o: kept.append(df.columns) or stored(df, **o))
    e = spark.createDataFrame([("a", "b", "r"), ("a", "b", "s"), ("c", "b", "r")], "src string, dst string, via string")
    got = graph.propagate(spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.4)], "id string, trust double"), e, rounds=1)
    assert kept[0] == ["src", "dst"] and {r.id: round(r.trust, 6) for r in got.collect()} == {"a": 1.0, "b": 0.24, "c": 0.4}


def test_edges_need_no_list_of_types(spark):
    from tracelake.operators import graph

    rows = [("e", "type", "Stream"), ("e", "from", "a"), ("e", "to", "b"), ("f", "type", "Rail"), ("f", "from", "a"), ("f", "to", "e"), ("a", "type", None), ("b", "type", "Step"), ("b", "type", "Node"), ("b", "label", "x")]
    got = graph.edges_of(spark.createDataFrame(rows, "s string, p string, o string"))
    assert "collect_set" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:4] for r in got.collect()] == [("e", "Stream", "a", "b")]


def test_stream_counts_make_no_rows_of_the_view(spark, monkeypatch):
    from tracelake.operators import views

    rnd = random.Random(5)
    node = lambda: rnd.choice([*(f"n{i}" for i in range(60)), None])
    for workflows, few, bits in ((3, 256, 62), (9, 256, 2), (9, 4, 62)):
        monkeypatch.setattr(views, "FEW", few)
        monkeypatch.setattr(views, "BITS", bits)
        rows = [(node(), rnd.choice("kl"), node()) for _ in range(45)]
        names = [*map(str, range(workflows))]
        owned = [(rnd.choice(names), node()) for _ in range(7)] + [("0", "alone"), ("1", rows[0][0])] * 2
        sides = lambda e, c, w: [x for x in e if x is not None and (w, x) in c]
        c = {x for x in owned if x[1] is not None}
        near = c | {(w, x) for w in names for s, _, d in rows if sides((s, d), c, w) for x in (s, d) if x is not None}
        view = {(w, *r) for w in names for r in rows if sides((r[0], r[2]), near, w)}
        want = {(w, len({x for v in view if v[0] == w for x in (v[1], v[3]) if x is not None}), sum(v[0] == w for v in view)) for w in {v[0] for v in view}}
        e, m = spark.createDataFrame(rows + rows[:9], "src string, kind string, dst string"), spark.createDataFrame(owned, "workflow string, node string")
        assert {tuple(r) for r in views.stream_view(e, m).collect()} == view
        if few > workflows:
            assert {tuple(r) for r in views.stream_counts(e, m).collect()} == want
    monkeypatch.undo()
    e = spark.createDataFrame([("a", "k", "b"), ("b", "k", "c")], "src string, kind string, dst string")
    m = spark.createDataFrame([(None, "a"), (3, "c")], "workflow int, node string")
    for own in (m, m.where("workflow IS NULL"), m.limit(0)):
        assert sorted(map(str, views.stream_counts(e, own).collect())) == sorted(map(str, views.view_counts(views.stream_view(e, own)).collect()))
    from tracelake.plans.workflows import QUERIES

    plan = QUERIES["grf8_stream_view"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 7
