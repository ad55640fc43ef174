import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tracelake.functions import text as fn
from tracelake.operators import grounding as G
from tracelake.plans import grounding as plan
from tracelake.sources import logs


@pytest.mark.parametrize("name", sorted(plan.QUERIES))
def test_query_matches_sql(spark, name):
    same(spark, plan.QUERIES[name], plan.ORACLE_SQL[name], "/root/testdata/sf0.01")


def _intents(spark):
    specs = [("ticket_ref", "entity_ref", True, None, None), ("new_priority", "enum", True, "ask", None)]
    return G.registry(spark.createDataFrame([("change", specs, None, None)], f"intent_id string, slot_specs {G.SPECS}, trigger_keywords array<string>, example_utterances array<string>"))


def test_commands(spark):
    rows = [
        ("t1", "s", "가  Ticket-217 높여", "change", ["run-1"], None),
        ("t2", "s", "no entity", "change", None, "ticket-9"),
        ("t3", "s", "no entity", "nothing", None, "ticket-9"),
        ("t4", None, None, None, None, None),
    ]
    u = spark.createDataFrame(rows, "turn_id string, session_id string, utterance string, intent_id string, run_ids array<string>, last_referenced_entity string")
    got = {r.turn_id: r for r in G.ground(u, _intents(spark)).collect()}
    assert (got["t1"].target_id, got["t1"].target_concepts, got["t1"].slots, got["t1"].confidence, got["t1"].reprompt_needed) == ("ticket-217", ["TicketEvent"], {"ticket_ref": "ticket-217", "new_priority": "high"}, 1.0, False)
    assert (got["t2"].target_id, got["t2"].reprompt_needed, got["t2"].reprompt_slots) == ("ticket-9", True, ["new_priority"])
    assert (got["t3"].target_id, got["t3"].slots, got["t3"].confidence, got["t3"].reprompt_needed) == (None, {}, 0.0, False)
    assert (got["t4"].confidence, got["t4"].reprompt_slots) == (0.0, [])
    assert G.ground(u.limit(0), _intents(spark)).count() == 0


def test_records_come_back_as_turns(spark, tmp_path):
    u = spark.createDataFrame([("t1", "s", "gate-7 low", "change", None, None)], "turn_id string, session_id string, utterance string, intent_id string, run_ids array<string>, last_referenced_entity string")
    for _ in range(2):
        G.append_turns(G.ground(u, _intents(spark)), str(tmp_path / "turns"))
    back = logs.scan_turns(spark, str(tmp_path / "turns")).collect()
    assert len(back) == 2 and (back[0].resolved_intent_id, back[0].reprompt_count, back[0].success, back[0].slots_filled) == ("change", 1, False, '{"new_priority":"low"}')


def test_references_and_concepts(spark):
    one = spark.range(1).select(F.lit("at H12  gate, then wf-a").alias("t"))
    r = one.select(fn.reference(F.col("t"), "gate").alias("g"), fn.reference(F.col("t"), "run").alias("n"), fn.concepts(F.lit("Gate-2")).alias("c"), fn.concepts(F.lit("ticket-x")).alias("d"), fn.concepts(F.lit("WF-x")).alias("e")).first()
    assert (r.g, r.n, r.c, r.d, r.e) == ("h12  gate", None, ["RunContext", "HITLGateContext"], [], ["WorkflowEntity"])
