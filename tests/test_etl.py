import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tracelake.operators import artifacts, etl
from tracelake.plans import etl as plan

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(plan.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, plan.QUERIES[name], plan.ORACLE_SQL[name], SF)


def test_old_nodes(spark):
    kind = "node string, type string, oracle_type string, criteria array<string>, pass_criteria array<string>, branches array<struct<on:string,goto:string>>"
    rows = [("a", "Validation", None, None, ["c"], None), ("b", "validation", "user", ["d"], ["c"], [("PASS", "x")]), ("c", "task", None, None, ["c"], None)]
    got = {r.node: r for r in etl.normalize_nodes(spark.createDataFrame(rows, kind)).collect()}
    assert (got["a"].type, got["a"].oracle_type, got["a"].criteria, [b.on for b in got["a"].branches]) == ("eval", "metric", ["c"], ["passed", "failed"])
    assert (got["b"].oracle_type, got["b"].criteria, [tuple(b) for b in got["b"].branches]) == ("user", ["d"], [("PASS", "x"), ("failed", None)])
    assert (got["c"].type, got["c"].criteria, got["c"].branches) == ("task", None, None)


def test_lost_branches_end_with_a_warning(spark):
    t = spark.createDataFrame([("a", "hasBranch", "x"), ("x", "on", "pass"), ("x", "gotoNode", "nowhere"), ("a", "usesTool", "[[t]]"), ("b", "hasBranch", "y"), ("y", "on", "fail"), ("y", "gotoNode", "a")], "s string, p string, o string")
    edges, warnings = etl.upgrade(t)
    got = {(r.src, r.kind, r.on): r.dst for r in edges.collect()}
    assert got["b", "default", "fail"] == "a" and got["a", "default", "pass"].startswith("end/") and got["a", "delegates_to", None].startswith("tool/")
    assert [tuple(r) for r in warnings.collect()] == [("a", "nowhere")]


def test_versions_and_tree(spark):
    t = spark.createDataFrame([("f", "s", "type", "Rail"), ("g", "s", "type", "Step"), ("g", "s", "next", "Rail")], "file string, s string, p string, o string")
    assert sorted(tuple(r) for r in etl.model_of(t).collect()) == [("f", True), ("g", False)]
    refs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "z")], "doc string, sub string")
    known = spark.createDataFrame([(x,) for x in "abcde"], "doc string")
    docs, issues = etl.resolve_tree(spark.createDataFrame([("a",)], "doc string"), refs, known)
    assert sorted((r.doc, r.depth) for r in docs.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert sorted((r.doc, r.issue) for r in issues.collect()) == [("a", "cycle"), ("e", "depth"), ("z", "missing")]


def test_roles_and_execution_edges(spark):
    r = spark.createDataFrame([("input-output",), ("Staging",), ("read",), ("other",)], "role string")
    p, c = artifacts.role_of(F.col("role"))[:2]
    assert [tuple(x) for x in r.select(p, c).collect()] == [(True, True), (True, True), (False, True), (False, False)]
    nodes = spark.createDataFrame([("p", None), ("a", "p"), ("b", "p"), ("c", "p")], "node string, phase string")
    edges, warnings = etl.execution_edges(nodes, spark.createDataFrame([("c", "a"), ("c", "gone")], "node string, on_node string"), spark.createDataFrame([("b", "a"), ("b", "lost")], "node string, goto string"))
    assert sorted(tuple(x) for x in edges.collect()) == [("a", "b", "lexical_next"), ("a", "c", "depends_on"), ("b", "a", "branch"), ("p", "a", "phase_entry")]
    assert [tuple(x) for x in warnings.collect()] == [("b", "lost")]


def test_typed_entries_json_and_similar(spark):
    e = spark.createDataFrame([("a", "t", [("r", "b"), (None, "c"), ("r", None)], ["x"], "red green blue"), (None, "t", None, None, "red"), ("c", "t", None, ["y"], "green green sky"), ("d", "", None, None, "")], "id string, type string, relations array<struct<type:string,target:string>>, tags array<string>, text string")
    assert [(r.id, len(r.relations)) for r in etl.typed_entries(e).orderBy("id").collect()] == [("a", 1), ("c", 0)]
    assert spark.range(1).select(etl.sorted_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))).first()[0] == '{"a":2,"b":1}'
    q = spark.createDataFrame([(1, None, "green sky"), (2, ["x"], "green"), (3, None, "none of it")], "query int, tags array<string>, text string")
    got = [(r.query, r.id, r.rank) for r in etl.similar(q, e.where("id IS NOT NULL")).orderBy("query", "rank").collect()]
    assert got == [(1, "c", 1), (1, "a", 2), (2, "a", 1)]


def test_delegates_types_and_classes(spark):
    from tracelake.operators import graph

    e = spark.createDataFrame([("t", "x", "delegates_to"), ("x", "a", "produces_to"), ("t", "a", "evolves_to"), ("a", "t", "reads")], "src string, dst string, kind string")
    m = spark.createDataFrame([("w", "t")], "workflow string, node string")
    none = spark.createDataFrame([], "src string, dst string")
    assert [tuple(r) for r in graph.improvement_issues(e, m, spark.createDataFrame([("a",)], "node string"), none).collect()] == [("t", "evolves_to", "a", "w", "self-produced")]
    a = spark.createDataFrame([("document", "file", "-", "table"), ("media", "file", "Human", "odd"), ("media", "file", "Human", None)], "artifact_type string, resource_kind string, primary_consumer string, explicit_type string")
    assert [tuple(r)[:3] for r in graph.with_explicit_type(a).collect()] == [("table", "data", "Tool + Agent"), ("media", "file", "Human"), ("media", "file", "Human")]
    t = spark.createDataFrame([("b", "type", "Class"), ("b", "subClassOf", "a"), ("c", "subClassOf", "a")], "s string, p string, o string")
    assert [tuple(r) for r in graph.class_edges(t).collect()] == [("a", "b")]
