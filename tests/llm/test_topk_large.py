"""Top-k with components of any size, and with more candidates than are evaluated at once."""

import math
import random

import pytest

from tracelake.llm import topk


@pytest.mark.parametrize("large", [3e7, 5e12, 1e15])
def test_large_components(spark, large):
    rnd = random.Random(int(large))
    rows = [(i, [rnd.choice([-1, 1]) * large * rnd.random() if rnd.random() < 1 / 7 else rnd.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    clipped = lambda x: min(max(x, 1 - 2**63), 2**63 - 1)
    want = set()
    for q in range(0, 1500, 50):
        best = sorted((-clipped(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(d.where("vec_id % 50 = 0"), d, query_block=16, candidate_block=4096)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want and 1500 > 2 * topk.STEP


def test_no_blocks_go_through_the_driver(spark):
    rnd = random.Random(7)
    rows = [(i, [float(rnd.randint(-9, 9)) for _ in range(4)]) for i in range(1500)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.top_k(d.where("vec_id % 10 = 0"), d, k=3, scale=1, query_block=16, candidate_block=100)
    want = {(q, r, i, -s) for q, v in rows[::10] for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:3], 1)}
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_copies_of_blocks_do_not_grow_with_blocks(spark, monkeypatch):
    assert topk.groups(25, 76, 48) == (1, 48) and topk.groups(3, 7, 24) == (3, 7) and topk.groups(1, 1, 32) == (1, 1)
    q, c = topk.groups(240, 750, 48)
    assert (q, c) == (4, 12)  # 240 * 12 + 750 * 4 blocks are shuffled, not 240 * 750
    monkeypatch.setattr(topk, "TOGETHER", 3)
    monkeypatch.setattr(topk, "FOR_A_CORE", 0)
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(600)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(d.where("vec_id % 10 = 0"), d, k=2, scale=1, query_block=8, candidate_block=60)
    want = {(q, r, i, -s) for q, v in rows[::10] for r, (s, i) in enumerate(sorted((-int(v[0] * w[0] + v[1] * w[1]), i) for i, w in rows if i != q)[:2], 1)}
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
