"""Audit events, pairs and de-duplication as streams against the same rows as a batch; evidence without what is declared."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelake.operators import graph
from tracelake.streaming import turns

START = datetime(2024, 1, 1)


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return spark.read.parquet(str(tmp_path / name))


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("\n".join(json.dumps(r | {"timestamp": r["timestamp"].isoformat() + "Z"}) for r in rows))
    os.utime(folder / f"{k}.json", (1e9 + k, 1e9 + k))  # files are taken in the order of their times


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_tool_events(spark, tmp_path):
    schema = "timestamp timestamp, tool string, command string, path string"
    rows = [("Bash", "c" * 300, None), ("Write", None, "p" * 100), ("Read", None, "x"), ("Task", None, None), ("Edit", "no", "é/ü")]
    put(tmp_path / "in", 0, [{"timestamp": START + timedelta(seconds=i), "tool": t, "command": c, "path": p} for i, (t, c, p) in enumerate(rows)])
    got = run(spark, turns.tool_events(source(spark, tmp_path / "in", schema)), tmp_path, "out").collect()
    assert sorted((r.tool, len(r.summary)) for r in got) == [("Bash", 200), ("Edit", 3), ("Task", 0), ("Write", 80)]
    batch = turns.tool_events(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()
    assert {r.id for r in got} == {r.id for r in batch} and len({r.id for r in got}) == 4 and all(r.id[:8] == "20240101" and r.day.isoformat() == "2024-01-01" for r in got)


def test_pairs(spark, tmp_path):
    schema = "turn_id string, prev_turn_id string, timestamp timestamp, resolved_intent_id string"
    at = [0, 10, 20, 200, 210]
    rows = [{"turn_id": f"t{i}", "prev_turn_id": f"t{i - 1}" if i else None, "timestamp": START + timedelta(minutes=m), "resolved_intent_id": f"i{i}"} for i, m in enumerate(at)]
    for k, part in enumerate(([rows[1]], [rows[0], rows[2]], rows[3:])):  # a turn before the one it follows
        put(tmp_path / "in", k, part)
    pairs = turns.previous_pairs(source(spark, tmp_path / "in", schema), source(spark, tmp_path / "in", schema), late="5 hours")
    got = sorted((r.from_intent, r.to_intent) for r in run(spark, pairs.select("from_intent", "to_intent"), tmp_path, "out").collect())
    assert got == [("i0", "i1"), ("i1", "i2"), ("i3", "i4")]  # t3 follows after three hours


def test_once_by_id(spark, tmp_path):
    schema = "id string, timestamp timestamp, n int"
    rows = [{"id": i, "timestamp": START + timedelta(minutes=m), "n": n} for n, (i, m) in enumerate([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 50), ("a", 51)])]
    for k in range(3):
        put(tmp_path / "in", k, rows[2 * k : 2 * k + 2])
    got = run(spark, turns.once_by_id(source(spark, tmp_path / "in", schema)), tmp_path, "out").collect()
    assert sorted((r.id, r.n) for r in got) == [("a", 0), ("b", 1), ("c", 3)]


def test_declared_pairs_are_not_derived_again(spark):
    s = spark.createDataFrame([("a", "consumed_by", "r"), ("b", "consumed_by", "r"), ("r", "produces_to", "c"), ("r", "produces_to", "a")], "src string, kind string, dst string")
    pairs = lambda df: {(r.src, r.dst) for r in df.select("src", "dst").collect()}
    assert pairs(graph.evidence(s)) == {("a", "c"), ("b", "c"), ("b", "a")}
    assert pairs(graph.evidence(s, explicit=spark.createDataFrame([("a", "c"), ("x", "y")], "src string, dst string"))) == {("b", "c"), ("b", "a")}
    assert graph.evidence(s).where(F.col("src") == F.col("dst")).count() == 0
