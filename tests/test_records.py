import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tracelake.operators import logs, memory
from tracelake.plans import queries, records

CHANGED = ["mem7_current_release", "mem8_validity", "mem9_active_invalidations", "mem10_revalidation", "mem12_relevance", "mem1_validate", "grf2_own_trust", "grf6_decisions", "grf16_uncovered", "agg11_hotspots", "agg12_repeated"]


@pytest.mark.parametrize("name", sorted({*records.ORACLE_SQL, *CHANGED}))
def test_query_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_results_are_not_empty(spark):
    for name in ("grf16_uncovered", "mem15_follow_up", "flt12_refs", "src9_edges"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1, name


def test_failure_fields_and_ids(spark):
    rows = [("s", i, v) for i, v in enumerate(['{"exception": "x", "tool": {"name": "t"}, "command": "c"}', '{"metadata": {"severity": "Blocked"}, "command": "c"}', '{"failure": "no"}', '{"run_id": "r"}', '{"entry_id": "", "ticket_id": "r"}', "[1]", "{", " "])]
    lines = spark.createDataFrame(rows, "scope string, line long, value string")
    assert sorted(tuple(r) for r in logs.hotspots(lines).collect()) == [("tool:c", 1)]
    assert [tuple(r) for r in logs.repeated(lines).collect()] == [("s", "r", 2)]
    assert [tuple(r) for r in logs.scope_counts(lines).collect()] == [("s", 7, 2)]


def test_fingerprint_sees_every_entry(spark):
    e = spark.range(500).select(F.concat(F.lit("E-"), "id").alias("id"), F.lit("episode").alias("type"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("created_at"))
    one = memory.fingerprint(e).first()[0]
    assert len(one) == 64 and memory.fingerprint(e.repartition(7).orderBy(F.desc("id"))).first()[0] == one
    assert memory.fingerprint(e.withColumn("text", F.when(F.col("id") == "E-77", "other").otherwise(F.col("text")))).first()[0] != one
