import pytest

from tracelake.operators import graph, views

STREAM = "src string, kind string, dst string"
MEMBER = "workflow string, node string"


def test_a_gate_elsewhere_hides_no_loop(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (7, 7), (8, 9)], "src int, dst int")
    gates = spark.createDataFrame([(3,)], "node int")
    assert {tuple(r) for r in graph.uncontrolled(e, gates).collect()} == {(1, 1), (2, 1), (7, 7)}
    assert graph.uncontrolled(e, spark.createDataFrame([(2,), (7,)], "node int")).count() == 0


def test_workflow_trust_has_three_parts(spark):
    runs = spark.createDataFrame([("r", "human", "m", "p", None), ("q", "other", None, None, None)], "node string, subject string, method string, policy string, timestamp string")
    e = graph.execution_trust(runs)
    got = {r.node: r.trust for r in e.collect()}
    assert got == pytest.approx({"r": 0.6 * 0.95 + 0.4 * 2 / 3, "q": 0.3})
    streams = spark.createDataFrame([("a", "consumed_by", "r"), ("a", "consumed_by", "r"), ("b", "consumed_by", "r"), ("r", "produces_to", "b")], STREAM)
    members = spark.createDataFrame([("w", "r"), ("w", "q"), ("v", "q"), ("u", "none")], MEMBER)
    trust = spark.createDataFrame([("a", 0.9), ("b", 0.3)], "id string, trust double")
    mine = {r.workflow: r.trust for r in graph.workflow_trust(streams, members, trust, e).collect()}
    executions = (got["r"] + got["q"]) / 2
    assert mine == {"w": pytest.approx(0.4 * 0.7 + 0.3 * executions + 0.3 * 0.3), "v": pytest.approx(0.3), "u": None}
    assert graph.workflow_trust(streams, members, trust).where("workflow = 'w'").first().trust == pytest.approx((0.4 * 0.7 + 0.3 * 0.3) / 0.7)


def test_control_and_combined_views(spark):
    rails = spark.createDataFrame([("r", "rail", "q"), ("r", "rail", "art"), ("x", "rail", "y")], STREAM)
    streams = spark.createDataFrame([("art", "consumed_by", "r"), ("art", "evidence_of", "far"), ("far", "consumed_by", "z")], STREAM)
    members = spark.createDataFrame([("w", "r")], MEMBER)
    artifacts = spark.createDataFrame([("art",), ("far",)], "id string")
    assert {tuple(r) for r in views.control_view(rails, members, artifacts).collect()} == {("w", "r", "rail", "q")}
    want = {("w", "r", "rail", "q"), ("w", "r", "rail", "art"), ("w", "art", "consumed_by", "r"), ("w", "art", "evidence_of", "far")}
    view = views.combined_view(rails, streams, members)
    assert {tuple(r) for r in view.collect()} == want
    members = members.unionByName(spark.createDataFrame([("w", "alone"), ("v", "alone")], MEMBER))
    assert {tuple(r) for r in views.view_counts(view, members).collect()} == {("w", 5, 4), ("v", 1, 0)}


def test_shared_artifacts(spark):
    rows = [("u", "s1", "f", "text", True, False), ("u", "s1", "f", "text", False, True), ("v", "s2", "f", "text", False, True), ("u", "s1", "g", "table", False, True), ("u", "s1", "h", None, True, False), ("u", "s1", "deliverable:d", "table", True, False)]
    uses = spark.createDataFrame(rows, "unit string, scope string, artifact string, type string, produces boolean, consumes boolean")
    got = {tuple(r) for r in graph.shared_artifacts(uses).collect()}
    assert got == {("u", "f", True, True), ("v", "f", False, True), ("u", "g", False, True)}


def test_strong_sets_equal_mutual_reach(spark):
    import random

    from tracelake.operators import graph

    r = random.Random(3)
    edges = list({(r.randrange(40), r.randrange(40)) for _ in range(70)})
    reach = {(a, b) for a, b in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    want = {(n, min(m for m in range(40) if (n, m) in reach and (m, n) in reach)) for n in range(40) if (n, n) in reach}
    got = graph.strong_sets(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {tuple(x) for x in got} == want
