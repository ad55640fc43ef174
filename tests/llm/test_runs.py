"""Runs against brute force: whole, word by word, in the query's columns, and rows of every kind."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tracelake.llm import runs

SF = "/root/testdata/sf0.001"


def brute(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rnd):
    w = []
    for _ in range(rnd.randint(0, 5)):
        unit = [rnd.choice("ab"[: rnd.randint(1, 2)] if rnd.random() < 0.7 else "abcdefgh") for _ in range(rnd.randint(1, 12))]
        w += unit * (rnd.randint(1, 9) if rnd.random() < 0.6 else 1)
        w *= rnd.randint(1, 4) if rnd.random() < 0.2 else 1
    return [c.encode() for c in w[:300]]


@pytest.mark.parametrize("step", [1 << 18, 50, 7, 1])
def test_runs_of_made_texts(monkeypatch, step):
    monkeypatch.setattr(runs, "WORDS", step)
    rnd = random.Random(step)
    for _ in range(150):
        docs, least = [made(rnd) for _ in range(rnd.randint(1, 4))], rnd.choice([24, 3, 7, 40])
        assert runs.runs_of(docs, least) == [brute(d, least) for d in docs]


def test_runs_are_told_as_they_grow():
    catcher, w = runs.SquareCatcher(), [*range(9)] * 4 + [50, 51]
    for i, x in enumerate(w):
        catcher.append(np.array([x]))
        assert [(s, e - s, q) for s, e, q in catcher.runs().tolist()] == brute(w[: i + 1])


def test_equal_prints_of_other_words_do_not_count(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda x: x % np.uint64(2))  # words of one parity look alike
    w = [b"a", b"b"] * 20 + [b"c", b"d"] * 3 + [b"a", b"b"] * 20
    assert runs.runs_of([w])[0] == brute(w)


def expected(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_columns(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(0, 300, 3)] + [(None, "x " * 30), (7, None), (8, ""), (9, " \n\t "), (9, " \n\t "), (10, "a b \x1c" * 40), (11, "y\x0b" * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, runs.op11_runs(spark, str(tmp_path)).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_on_the_tables(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in runs.op11_runs(spark, SF).collect()}
    assert len(docs) > 100 and any(got[d.doc_id][1] for d in docs)
    for d in docs:
        assert got[d.doc_id] == expected(*d)


def test_other_columns_stay(spark):
    d = spark.createDataFrame([(1, "a " * 30, 5, "x")], "doc_id long, text string, runs int, n string")
    assert [tuple(r) for r in runs.find_runs(d).select("doc_id", "n", "n_words", "runs", "collapsed").collect()] == [(1, "x", 30, [(0, 30, 1)], "a")]
    assert runs.find_runs(d.limit(0)).count() == 0
