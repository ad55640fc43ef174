import datetime
import json

from pyspark.sql import functions as F

from tracelake.functions import text as fn
from tracelake.operators import graph, memory, turns
from tracelake.sources import logs
from tracelake.streaming import turns as streaming


def _turns(spark):
    t0 = datetime.datetime(2024, 1, 30, 10)
    rows = [
        ("t1", "s", t0, "a", ["x", None], 0, True, 120, None), ("t2", "s", t0 + datetime.timedelta(minutes=1), "b", ["y"], 1, True, 95, "t1"), ("t3", "s", t0, "a", [], 0, None, 1, "t2"),
        ("t4", "s", t0 - datetime.timedelta(days=9), "a", ["x"], 0, True, 5, None), ("t5", "s", t0, "b", None, 0, True, 5, "t4"), ("t6", "s", t0, None, ["x"], 0, True, 5, "t1"),
    ]
    return spark.createDataFrame(rows, "turn_id string, session_id string, timestamp timestamp, resolved_intent_id string, resolved_target_concepts array<string>, reprompt_count int, success boolean, duration_ms int, prev_turn_id string")


def test_transitions_at_the_window_bound(spark):
    got = {(r.from_intent, r.to_intent): r.cnt for r in turns.transition_matrix(_turns(spark)).collect()}
    assert got == {("a", "b"): 2}
    assert {tuple(r) for r in turns.factored(_turns(spark)).collect()} == {("a", "x", "b", "y", 1), ("a", "_no_concept", "b", "y", 1)}
    assert turns.funnel(_turns(spark).limit(0)).count() == 0


def test_turn_scan_keeps_good_rows(spark, tmp_path):
    good = {"type": "turn", "turn_id": "t1", "reprompt_count": 0}
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps({"type": "schema"}), json.dumps(good), "{bad", json.dumps(good | {"turn_id": "t2", "reprompt_count": "x"})]))
    got = {r.turn_id: r.reprompt_count for r in logs.scan_turns(spark, str(tmp_path)).collect()}
    assert got == {"t1": 0, "t2": None}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    _turns(spark).write.json(str(src))
    schema = _turns(spark).schema
    q = streaming.sliding_funnel(spark.readStream.schema(schema).json(str(src)), late="30 days").writeStream.format("memory").queryName("funnel").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.sliding_funnel(spark.read.schema(schema).json(str(src)), late="30 days")
    assert sorted(map(str, spark.table("funnel").collect())) == sorted(map(str, batch.collect()))


def test_graph_loops_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 5), (5, 4), (3, 6)], "src int, dst int")
    gates = spark.createDataFrame([(4,)], "node int")
    assert {tuple(r) for r in graph.loops(e, gates).collect()} == {(1, 1), (2, 1)}
    line = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")
    assert {tuple(r) for r in graph.levels(line).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_release_state(spark):
    rows = [("UD-1", "user-decision", "1", [("invalidated-by", "RN-2")], None), ("RN-1", "release-note", "1", [], {"released_at": ""}), ("RN-2", "release-note", "2", [], {"kind": "release"}), ("RN-3", "release-note", "3", [("rolls-back", "RN-2")], {"kind": "rollback"})]
    e = spark.createDataFrame(rows, "id string, type string, created_at string, relations array<struct<type:string,target:string>>, metadata map<string,string>")
    assert [r.id for r in memory.current_release(e).collect()] == ["RN-1"]
    assert [tuple(r) for r in memory.validity(e).collect()] == [("UD-1", "invalidated-by", "RN-2", "suspended")]
    e = e.where("id <> 'RN-3'")
    assert [r.id for r in memory.current_release(e).collect()] == ["RN-2"]
    assert [tuple(r) for r in memory.validity(e).collect()] == [("UD-1", "invalidated-by", "RN-2", "active")]


def test_text_functions(spark):
    one = spark.createDataFrame([("ticket-217 재실행", "./a\\b//c")], "t string, p string")
    r = one.select(fn.reference(F.col("t"), "ticket").alias("ref"), fn.concepts(F.lit("ticket-217")).alias("c"), fn.locator(F.col("p")).alias("l"), fn.language(F.col("t")).alias("g")).first()
    assert (r.ref, r.c, r.l, r.g) == ("ticket-217", ["TicketEvent"], "a/b/c", "mixed")
