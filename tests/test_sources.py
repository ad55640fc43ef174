"""Sources and sinks on trees of files: discovery, scopes, line numbers, skip and audit mode, first and last of an id, appends, compaction."""

import json

from tracelake.operators import memory
from tracelake.sources import files, logs


def put(folder, name, *lines):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + ("\n" if lines else ""))
    return str(at)


def names(df):
    return [(r.path.rsplit("/", 1)[-1], r["rank"]) for r in df.collect()]


def test_discovery(spark, tmp_path):
    for n in ("b/x.abox.ttl", "b/x.inferred.ttl", "a.abox.ttl", "c/d/y.inferred.ttl", "c/d/empty.abox.ttl", "c/other.ttl", ".hidden/z.abox.ttl", "c/note.md"):
        put(tmp_path, n, *([] if "empty" in n else ["t"]))
    named = put(tmp_path / "elsewhere", "one.abox.ttl", "t")
    put(tmp_path / "elsewhere", "one.inferred.ttl", "t")
    plain = put(tmp_path / "elsewhere", "plain.ttl", "t")
    root, c = str(tmp_path), str(tmp_path / "c")
    got = files.discover(spark, [f"{root}/b", c, f"{c}/d", named, plain, f"{root}/gone", f"{root}/gone.ttl", f"{c}/note.md"])
    assert names(got) == [("x.abox.ttl", 0), ("empty.abox.ttl", 0), ("one.abox.ttl", 0), ("plain.ttl", 0), ("x.inferred.ttl", 1), ("y.inferred.ttl", 1), ("one.inferred.ttl", 1)]
    assert {r.length for r in got.collect()} == {0, 2}
    assert [n for n, _ in names(files.discover(spark, [root], patterns=("*.inferred.ttl", "*.ttl")))] == ["x.inferred.ttl", "y.inferred.ttl", "one.inferred.ttl", "a.abox.ttl", "x.abox.ttl", "empty.abox.ttl", "other.ttl", "one.abox.ttl", "plain.ttl"]
    assert files.discover(spark, []).count() == 0


def test_scopes(spark, tmp_path):
    wm = "agent-context/work-memory"
    put(tmp_path, f"{wm}/track/a.jsonl", {"id": "1"}, "", "[1]", "{bad")
    put(tmp_path, f"{wm}/track/deep/b.jsonl")
    put(tmp_path, f"{wm}/auditlog/2024/a.jsonl", {"id": "2"})
    put(tmp_path, f"{wm}/track/worklog/a.jsonl", {"id": "no scope"})
    put(tmp_path, f"{wm}/.old/a.jsonl", {"id": "hidden"})
    put(tmp_path, ".mso-context/conversation/turns.jsonl", {"type": "header"}, {"type": "turn"})
    root = str(tmp_path)
    assert {r["scope"]: (r.files, r.records, r.bad) for r in files.runtime_counts(spark, root).collect()} == {"memory": (2, 3, 2), "audit": (1, 1, 0), "worklog": (0, 0, 0), "intent": (1, 2, 0)}
    assert sorted((r["scope"], r.line, r.value) for r in files.runtime_lines(spark, root).where("scope = 'memory'").collect()) == [("memory", 1, '{"id": "1"}'), ("memory", 2, ""), ("memory", 3, "[1]"), ("memory", 4, "{bad")]
    assert {r.files for r in files.runtime_counts(spark, f"{root}/none").collect()} == {0}


def test_lines_are_numbered_over_many_blocks(spark, tmp_path):
    want = [f"{i} " + "x" * (i % 97) for i in range(5000)]
    put(tmp_path, "a/long.jsonl", *want)
    put(tmp_path, "a/short.jsonl", "one", "two")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = files.numbered(spark, str(tmp_path / "a")).collect()
        assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in sorted((r for r in got if r.path.endswith("long.jsonl")), key=lambda r: r.line)] == want
    assert {r.line: r.value for r in got if r.path.endswith("short.jsonl")} == {1: "one", 2: "two"} and len(got) == 5002


def test_entries_skip_audit_first_last(spark, tmp_path):
    put(tmp_path, "m/a.jsonl", {"id": "EP-1", "type": "episode", "title": "old", "created_at": "1"}, "", "not json", "[1, 2]", '"text"', {"id": "EP-1", "type": "episode", "title": "new", "created_at": "2"})
    put(tmp_path, "m/.zvec/a.jsonl", {"id": "hidden"})
    root = str(tmp_path / "m")
    assert [r.title for r in logs.scan_entries(spark, root).orderBy("created_at").collect()] == ["old", "new"]
    audit = {r.line: (r.id, r.bad) for r in logs.scan_entries(spark, root, audit=True).collect()}
    assert audit == {1: ("EP-1", None), 3: (None, "not json"), 4: (None, "[1, 2]"), 5: (None, '"text"'), 6: ("EP-1", None)}
    e = logs.scan_entries(spark, root)
    assert [r.title for r in logs.first_of(e, e["created_at"]).collect()] == ["old"]
    assert [r.title for r in logs.first_of(e, e["created_at"].desc()).collect()] == ["new"]
    issues = memory.validate(logs.scan_entries(spark, root, audit=True), prefixes={"episode": "XX"}).collect()
    assert sorted(r.issue for r in issues if "parse" in r.issue) == ['parse error: "text"', "parse error: [1, 2]", "parse error: not json"]
    assert sum(r.issue == "id is not XX of episode" for r in issues) == 2 and sum(r.issue == "duplicate id" for r in issues) == 1


def test_appends_and_compaction(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, "id string, type string, created_at string")
    logs.append_new(rows(("a", "episode", "1"), ("a", "episode", "1"), ("b", "episode", "2")), rows(("z", "episode", "0")), log)
    logs.append_new(rows(("a", "episode", "9"), ("c", "episode", "3")), spark.read.json(log), log)
    assert sorted((r.id, r.created_at) for r in spark.read.json(log).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    out = str(tmp_path / "out")
    logs.compact(rows(("EP-2", "x", "2"), ("EP-1", None, "1"), ("UD-1", "episode", "3"), ("Q-1", "worklog", "1"), ("Q-2", "other", "1")), out, prefixes={"episode": "EP", "user-decision": "UD"})
    assert sorted((r.type, r.id) for r in spark.read.json(out).collect()) == [("episode", "EP-1"), ("episode", "EP-2"), ("other", "Q-2"), ("user-decision", "UD-1")]
