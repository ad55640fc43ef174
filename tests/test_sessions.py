"""Sessions over batch and stream: windows against a plain loop, the stream against the batch, late and repeated turns, recovery."""

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelake.operators import grounding as G
from tracelake.operators import sessions
from tracelake.sources import logs
from tracelake.streaming import grounding as stream

START = datetime(2024, 1, 1)
SCHEMA = "session_id string, turn_id string, timestamp timestamp, utterance string, intent_id string"
SPECS = {
    "I1": [("ticket_ref", "entity_ref", True, "ask", None), ("run_ref", "entity_ref", False, "ask", None)],
    "I2": [("run_ref", "entity_ref", True, "default", "run-d"), ("note", "free_text", False, "ask", None)],
    "I3": [("workflow_ref", "entity_ref", True, "default", "wf-main"), ("workflow_ref", "entity_ref", False, "ask", None)],
    "I4": [("gate_ref", "entity_ref", False, "ask", None), ("ref", "entity_ref", False, "default", "gate-x")],
    "I5": [],
}


def registry(spark):
    return G.registry(spark.createDataFrame([(i, s, None, None) for i, s in SPECS.items()] + [("I5", None, ["again"], None)], f"intent_id string, slot_specs {G.SPECS}, trigger_keywords array<string>, example_utterances array<string>"))


def turns(rnd, n=300):
    out = []
    for i in range(n):
        text = rnd.choice(["", "hello", f"ticket-{i}", f"RUN-a{i} please", f"wf-{i} and gate-{i}", f"run-b{i} on H{i} gate"])
        out.append((rnd.choice(["s1", "s1", "s1", "s2", "s3"]), f"t{i:04}", START + timedelta(minutes=i * 11 + rnd.choice([0, 0, 900])), text, rnd.choice(["I1", "I2", "I3", "I4", "I5", "nothing"])))
    return out


def looped(spark, rows, idle=timedelta(hours=12)):
    """Session by session, turn by turn, each grounded on its own with the session's state."""
    intents, state, out = registry(spark), {}, {}
    pending = sorted(set(rows), key=lambda r: (r[2], r[1]))
    while pending:  # the next turn of every session in one job
        now, rest, taken = [], [], set()
        for r in pending:
            (rest if r[0] in taken else now).append(r)
            taken.add(r[0])
        given = []
        for r in now:
            s = state.get(r[0])
            if s is None or r[2] - s[3] > idle:
                s = state[r[0]] = [None, None, None, r[2]]
            given.append((*r, [s[0]] if s[0] else [], s[1], s[2]))
            out[r[1]] = ([s[0]] if s[0] else [], s[1], s[2])
        u = spark.createDataFrame(given, SCHEMA + ", run_ids array<string>, last_referenced_entity string, prev_turn_id string").coalesce(1)
        for c in G.ground(u, intents).withColumn("said", sessions.fn.reference(F.col("utterance"), "run")).collect():
            s = state[c.session_id]
            state[c.session_id] = [s[0] or c.said, c.target_id or s[1], c.turn_id, c.timestamp]
        pending = rest
    return out


def test_windows_equal_a_loop(spark):
    rows = turns(random.Random(2), 24)
    want = looped(spark, rows)
    for span in ("hour", "year"):
        got = sessions.with_session(spark.createDataFrame([*rows, rows[3], (None, "x", START, "", "I1")], SCHEMA), registry(spark), span=span).collect()
        assert len(got) == len(rows) and {r.turn_id: (r.run_ids, r.last_referenced_entity, r.prev_turn_id) for r in got} == want
    assert len({v[1] for v in want.values()}) > 3 and sum(v[2] is None for v in want.values()) >= 3


def _put(folder, k, rows):
    lines = [json.dumps(dict(zip(("session_id", "turn_id", "timestamp", "utterance", "intent_id"), (*r[:2], r[2].isoformat() + "Z", *r[3:]), strict=True))) for r in rows]
    (folder / f"{k:03}.json").write_text("\n".join(lines))
    os.utime(folder / f"{k:03}.json", (1e9 + k, 1e9 + k))  # files are taken in the order of their times


def test_stream_equals_batch(spark, tmp_path):
    rows = turns(random.Random(7))
    rnd, late = random.Random(1), timedelta(hours=40)
    order = sorted(rows, key=lambda r: r[2] + rnd.random() * timedelta(hours=20))  # out of order by 20 hours and a file at most
    parts = [order[i : i + 50] for i in range(0, len(order), 50)]
    parts = [p + rnd.sample(order[: (k + 1) * 50], 10) for k, p in enumerate(parts)]  # repeats of what has come, waiting or done
    parts[-1].append(("s1", "too late", START, "ticket-1", "I1"))
    parts.append([("end", "end", START + timedelta(days=400), "", "I1")])
    source, sink, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()

    def run(k, some):
        for i, p in enumerate(some):
            _put(source, k + i, p)
        for _ in range(2):  # the second run finds nothing new
            u = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
            q = stream.turn_log(u, registry(spark), sink, check, late=f"{late // timedelta(hours=1)} hours", availableNow=True)
            assert q.awaitTermination(120) and q.exception() is None

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run(0, parts[:3])  # each run goes on from the checkpoint of the one before
        run(3, parts[3:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    batch = G.turn_records(G.ground(sessions.with_session(spark.createDataFrame(rows, SCHEMA), registry(spark)), registry(spark)))
    cols = ["turn_id", "session_id", "utterance", "resolved_intent_id", "resolved_target_entity_id", "slots_filled", "reprompt_count", "success", "prev_turn_id"]
    told = lambda df: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert told(logs.scan_turns(spark, sink)) == told(batch)


def test_repeated_declarations(spark):
    u = spark.createDataFrame([("s", "t", START, "wf-1", "I3"), ("s", "u", START, "", "I5")], SCHEMA).withColumns({"run_ids": F.array().cast("array<string>"), "last_referenced_entity": F.lit(None).cast("string")})
    got = {r.turn_id: r for r in G.ground(u, registry(spark)).collect()}
    assert got["t"].slots == {"workflow_ref": "wf-1"} and len(got) == 2
