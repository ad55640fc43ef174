"""Sampled segmentations against all paths of small lattices, and the cases of encode_samples."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import segment


def _paths(text, v):
    """{ids: log-probability} of all segmentations, by enumeration."""
    pieces = {}
    for i, b in enumerate(v.bytes_of):
        if v.logw[i] < 0:
            pieces.setdefault(b, i)
    done = [((), 0.0)]
    for unit in segment._UNIT.findall(" " + text):
        u = unit.encode()

        def cuts(at):
            if at == len(u):
                return [((), 0.0)]
            return [((pieces[u[at:e]], *ids), v.logw[pieces[u[at:e]]] + w) for e in range(at + 1, len(u) + 1) if u[at:e] in pieces for ids, w in cuts(e)]

        done = [((*a, *b), x + y) for a, x in done for b, y in cuts(0)]
    total = math.log(sum(math.exp(w) for _, w in done))
    return {ids: w - total for ids, w in done}


def test_equals_enumeration():
    v = segment.vocabulary(segment.MODEL)
    for text in ("ab", "the", "a to"):
        want = _paths(text, v)
        keys = segment._mix(np.arange(3, dtype=np.uint64))
        for t in range(3):
            got = [r for r in segment.sample_runs([text] * 3, keys, v, k=len(want) + 5, alpha=1.0) if r[0] == t]
            assert {tuple(r[2].tolist()) for r in got} == set(want) and len(got) == len(want)
            assert all(abs(r[3] - want[tuple(r[2].tolist())]) < 1e-9 for r in got)
            assert [r[4] for r in got] == sorted((r[4] for r in got), reverse=True) and all(r[5] == 1.0 for r in got)


def test_inclusion_scores_are_unbiased():
    v = segment.vocabulary(segment.MODEL)
    want, n = _paths("ab", v), 6000
    first, weight = {}, {}
    for r in segment.sample_runs(["ab"] * n, segment._mix(np.arange(n, dtype=np.uint64)), v, k=2, alpha=1.0):
        ids = tuple(r[2].tolist())
        weight[ids] = weight.get(ids, 0) + 1 / r[5]
        if r[1] == 1:
            first[ids] = first.get(ids, 0) + 1
    for ids, w in want.items():
        p = math.exp(w)
        if p > 0.01:
            assert abs(first.get(ids, 0) / n - p) < 4 * math.sqrt(p / n) + 0.002  # the first is drawn with its probability
            assert abs(weight.get(ids, 0) / n - 1) < 0.25


def test_a_sample_does_not_depend_on_its_neighbours(monkeypatch):
    v = segment.vocabulary(segment.MODEL)
    texts = [f"some words {i} here, é{i} and 日本" for i in range(40)]
    keys = segment._mix(np.arange(40, dtype=np.uint64))
    whole = [(*r[:2], tuple(r[2].tolist()), *r[3:]) for r in segment.sample_runs(texts, keys, v, k=3, alpha=1.0)]
    monkeypatch.setattr(segment, "RUN", 7)
    monkeypatch.setattr(segment, "ARCS", 300)
    assert whole == [(*r[:2], tuple(r[2].tolist()), *r[3:]) for r in segment.sample_runs(texts, keys, v, k=3, alpha=1.0)]
    alone = [(17, r[1], tuple(r[2].tolist()), *r[3:]) for r in segment.sample_runs(texts[17:18], keys[17:18], v, k=3, alpha=1.0)]
    assert alone == [r for r in whole if r[0] == 17]


def test_cases(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "x"), (3, ""), (4, "a\U0010fffe ▁ b\n\n  c"), (5, " word" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "ids": F.lit(0), "kept": F.lit(7)})
    got = segment.encode_samples(docs, k=2)
    assert got.columns == ["doc_id", "kept", "rank", "ids", "log_prob", "perturbed", "inclusion", "round_trip"]
    found = got.collect()
    assert all(r.round_trip and r.kept == 7 for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 4 and len(by[2]) == 1 and by[2][0].ids == [] and by[2][0].inclusion == 1.0 and len(by[3]) == 1 and len(by[5]) == 2
    assert sorted(map(str, by[1][:2])) == sorted(map(str, by[1][2:]))
    assert segment.encode_samples(docs.limit(0)).count() == 0 and segment.encoded(docs.select("doc_id", "text")).where("NOT round_trip").count() == 0
    decoded = got.select("doc_id", segment.decode(F.col("ids")).alias("t")).distinct().collect()
    assert {(r.doc_id, r.t) for r in decoded} == {(i, t or "") for i, t in rows}
