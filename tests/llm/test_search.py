"""Ranked search against brute force: the query's SQL, bounds, ties, several groups of items, small blocks and rows of every kind."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tracelake.llm import search

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=50):
    counted = [(i, Counter(terms(t)), len(terms(t)), t) for i, t in docs]
    counted = [c for c in counted if c[2]]
    N, L = len(counted), sum(c[2] for c in counted)
    df = Counter(t for c in counted for t in c[1])
    out = []
    for item, text in items:
        found = []
        for i, tf, n, _ in counted:
            m = 100 - 50 + 50 * n * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_sql(spark):
    same(spark, search.op13_search, search.OP13_SQL, SF)


@pytest.mark.parametrize("seed", range(3))
def test_made_texts(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    pool = [*"abcdefghij", "É", "é", "日本", *(f"w{i}" for i in range(300))]
    text = lambda n: "".join(rnd.choice(pool[: rnd.choice([8, 40, 313])]).title() + rnd.choice([" ", "  ", ", ", ".\n", "_", "-"]) for _ in range(n))
    docs = [(i, text(rnd.choice([1, 3, 20, 200, 900]))) for i in range(150)]
    docs += [docs[3], docs[3], (docs[4][0], "a b c"), (None, "a b w1"), (900, None), (901, ""), (902, " .,; "), (903, docs[5][1]), (904, docs[5][1])]
    items = [(i, text(rnd.choice([1, 5, 60]))) for i in range(7)] + [(7, None), (8, "..."), (9, "absent words"), (None, "a w1 w2")]
    monkeypatch.setattr(search, "GROUP", 150)  # several groups
    monkeypatch.setattr(search, "RUN", 3000)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 10)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "item": F.lit("x"), "value": F.lit(2), "item_id": F.lit(3)}).repartition(3)
    q = spark.createDataFrame([*items, items[0]], "item_id int, text string").withColumn("doc_id", F.lit(0))
    got = [tuple(r) for r in search.search(d, q, k=5).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == brute(docs, items, 5)


def test_bounds_are_never_below_scores(spark):
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()) if r.text]
    items = [search.terms_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = search.index(docs, np.full(1 << search.TABLE - 6, 2**64 - 1, np.uint64)).collect()
    df = Counter(t for _, text in rows for t in set(search.terms_of(text)))
    assert {bytes(t): n for b in blocks for t, n in zip(b.terms, b.counts)} == df
    model, text_of = search.Model(items, df, sum(b.n_docs for b in blocks), sum(b.n_terms for b in blocks)), dict(rows)
    near = []
    for b in blocks:
        bound, score = model.bounds(b.lengths, b.bits, b.slices), model.scores([text_of[i] for i in b.ids])
        assert (bound >= score).all()
        near += (score[bound > 0] / bound[bound > 0]).tolist()
    assert np.mean(near) > 0.6 and len(blocks) > 2


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(d.limit(0), q).count() == search.search(d, q.limit(0)).count() == search.search(d.where("text IS NULL"), q).count() == 0
    assert [tuple(r) for r in search.search(d, q).collect()] == [(1, 1, 1, 287 * 333_333)]
