"""Substring dedup against brute force: hot passages and hot anchors, one document in several rows, windows in several places."""

import random

import pytest

from tracelake.llm import substrings


def _brute(rows, window):
    """doc_id None is not compared; of each other row the words that stay."""
    first = {}
    for i, text in rows:
        w = (text or "").split(" ")
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").split(" ")
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, text if text is None else " ".join(x for k, x in enumerate(w) if k not in gone), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_share, batch", [(10_000, 10_000), (3, 7), (40, 3)])
def test_equals_brute_force(spark, hot_share, batch, monkeypatch):
    r = random.Random(hot_share)
    passages = [" ".join(f"p{k}_{x}" for x in range(n)) for k, n in enumerate((13, 14, 20, 40, 12))]
    hot = " ".join(f"h{x}" for x in range(30))
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(r.choice([*passages, " ".join(r.choice("abc") for _ in range(r.randint(1, 30))), f"own{i} " * 3 + "end"]))
        if i % 3 == 0:
            parts.insert(r.randrange(len(parts) + 1), hot)
        rows.append((r.randint(0, 90), " ".join(parts)))
    rows += [(None, hot), (5, None), (7, "a b")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot_share=hot_share)
        assert sorted(((x.doc_id, x.text, x.n_removed) for x in got.collect()), key=repr) == _brute(rows, 13)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_string_ids_and_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [("b", long + " x"), ("a", long), ("é", long[:500])]
    got = {x.doc_id: (x.text, x.n_removed) for x in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["a"] == (long, 0) and got["b"] == ("x", 100_000) and got["é"][1] > 50
