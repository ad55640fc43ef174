"""Node tables: no row holds the nodes of a phase; branches that are alike stay apart, triples that are said twice don't count twice."""

from tracelake.operators import workflow


def test_phases_own_nodes_without_a_list_of_them(spark):
    t = [("w#p/1", "type", "Phase"), ("w#p/2", "type", "Phase"), ("w#p/2", "type", "Step"), ("w#p/1", "hasBranch", "b1")]
    t += [("w#n/1", "type", "Step"), ("w#n/2", "type", "Decision"), ("w#n/2", "judge", "human"), ("w#p/1", "hasNode", "w#n/1"), ("w#p/2", "hasNode", "w#n/2")]
    t += [("w#n/1", "hasBranch", "b1"), ("w#n/1", "hasBranch", "b1"), ("w#n/1", "hasBranch", "b2"), ("w#n/1", "hasBranch", "b3"), ("b1", "on", "pass"), ("b2", "on", "pass"), ("b3", "goto", "x"), ("b1", "goto", ""), ("b2", "label", "")]
    routes = spark.createDataFrame([("human", "desk")], "judge string, provider string")
    defaults = spark.createDataFrame([("step", "runner")], "type string, provider string")
    got = workflow.node_table(spark.createDataFrame(t, "s string, p string, o string"), routes, defaults)
    assert {(r.id, r.type, r.phase_id, r.provider, tuple(map(tuple, r.branches))) for r in got.collect()} == {
        ("1", "phase", None, "local-ollama", ()), ("2", "step", None, "runner", ()), ("1", "step", "1", "runner", (("pass", "", "pass"), ("pass", "", "pass"))), ("2", "decision", None, "desk", ()),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("collect_set" in line and "hasNode" in line for line in plan.splitlines())
