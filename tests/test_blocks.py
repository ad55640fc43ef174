"""Pairs of queries and entries are scored in blocks: right over several of them, and no pair is a row before it can rank."""

import math

import pytest
from pyspark.sql import functions as F

from tracelake.operators import matching

N, Q = 600, 40


@pytest.fixture
def uneven(spark):
    """No joining of small partitions, so the blocks' keys decide which task they meet in."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_blocks_in_several_tasks_equal_all_pairs(uneven, monkeypatch):
    """Every entry shares ten words with every query; a third are copies of one another, which tie."""
    monkeypatch.setattr(matching, "QUERIES", 9)
    worth = lambda i: 50 if i % 3 == 0 else i * 7 % 41
    entries = uneven.range(N).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("t")).withColumn("w", F.lit(1))
    queries = uneven.range(Q).select(F.col("id").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("t")).withColumn("w", F.lit(2))
    known = uneven.createDataFrame([(i, worth(i)) for i in range(N)], "id long, worth int")
    got = matching.top_k(queries, entries, known, queries.select("query").distinct(), k=3, order=[F.col("score").desc(), F.col("id")], met=(F.col("id") + F.col("query")) % 5 != 0, seed=50)
    want = set()
    for q in range(Q):
        best = sorted((-20 - worth(i), i) for i in range(N) if (i + q) % 5)[:3]
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(best, 1)}
    assert {(r.query, r.id, r.score, r["rank"]) for r in got.collect()} == want
    assert dict(got.dtypes)["score"] == "bigint"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode" in plan


def test_an_entry_without_a_common_term_counts_where_it_may(spark):
    entries = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, t string, w int")
    queries = spark.createDataFrame([(7, "a", 1), (8, "none", 1)], "query int, t string, w int")
    known = spark.createDataFrame([(1, 0, False), (2, 5, False), (3, 4, True)], "id int, worth int, free boolean")
    got = matching.top_k(queries, entries, known, queries.select("query"), k=2, order=[F.col("score").desc(), F.col("id")], bare=F.col("free"))
    assert {(r.query, r.id, r.score, r["rank"]) for r in got.collect()} == {(7, 3, 4, 1), (7, 1, 1, 2), (8, 3, 4, 1)}


def test_context_joins_texts_of_what_was_found_only(spark):
    from tracelake.operators import memory

    nodes = spark.createDataFrame([("n", "alpha beta", ["en"], None)], "node string, text string, tags array<string>, types array<string>")
    entries = spark.createDataFrame([(f"E-{x}", "x", None, "alpha" if x < 2 else "other", [], None, str(x)) for x in range(9)], "id string, type string, title string, text string, tags array<string>, module string, created_at string")
    got = memory.context_pack(nodes, entries, spark.createDataFrame([("E-7", "E-0"), ("E-8", "E-7")], "src string, dst string"), k=1)
    assert {(r.id, r.depth, r.score) for r in got.collect()} == {("E-0", 0, 1), ("E-7", 1, 0)}
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_gives_scores_unrounded_and_hashes_in_one_pass(spark):
    from tracelake.operators import etl

    e = spark.createDataFrame([(1, [], "aaa bbb ccc"), (2, [], "aaa ddd"), (3, [], None)], "id int, tags array<string>, text string")
    q = spark.createDataFrame([(7, [], "AAA bbb bbb")], "query int, tags array<string>, text string")
    got = etl.similar(q, e).orderBy("rank").collect()
    common, rare = math.log(1 + 3 / 2), math.log(1 + 3)
    want = (common**2 + 2 * rare**2) / (math.hypot(common, 2 * rare) * math.sqrt(common**2 + 2 * rare**2))
    assert [r.id for r in got] == [1, 2]
    assert abs(got[0].score - want) < 1e-12 < abs(round(want, 9) - want)
