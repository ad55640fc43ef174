import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import matching


@pytest.mark.parametrize("seed, unit", [(1, False), (2, True), (3, False)])
def test_top_k_equals_all_pairs(spark, seed, unit):
    rnd = random.Random(seed)
    draw = lambda n: {min(int(rnd.expovariate(0.08)), 90): rnd.choice([1, 1, 2, 5]) for _ in range(n)}
    vectors = [(i, draw(rnd.choice([2, 8, 40]))) for i in range(300)]
    asked = [(i, draw(rnd.choice([1, 6, 20]))) for i in range(12)] + [(99, {1000: 1})]
    if unit:
        vectors = [(i, {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()}) for i, v in vectors]
    worth = {i: 0 if unit else rnd.choice([0, 3, 7]) for i, _ in vectors}
    want = set()
    for q, a in asked:
        got = [(-round(worth[i] + sum(w * v.get(t, 0) for t, w in a.items()), 9), i) for i, v in vectors if set(a) & set(v) and (i + q) % 7]
        want |= {(q, i, float(-s), r) for r, (s, i) in enumerate(sorted(got)[:4], 1)}
    flat = lambda rows, key: spark.createDataFrame([(i, t, float(w)) for i, v in rows for t, w in v.items()], f"{key} int, t int, w double")
    known = spark.createDataFrame([(i, float(worth[i]), len(v)) for i, v in vectors], "id int, worth double, size int")
    got = matching.top_k(
        flat(asked, "query"), flat(vectors, "id"), known, spark.createDataFrame([(q,) for q, _ in asked], "query int"), k=4, order=[F.col("score").desc(), F.col("id")],
        met=(F.col("id") + F.col("query")) % 7 != 0, most=0 if unit else 7, unit=unit, digits=9, seed=10, tiers=F.col("size") if seed > 1 else None,
    )
    assert {(r.query, r.id, r.score, r["rank"]) for r in got.collect()} == want
