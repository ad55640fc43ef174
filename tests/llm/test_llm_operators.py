import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tracelake.llm import decontamination, licenses, lines, pii, quality, queries, segment, simhash, substrings, topk, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(3000))
P = " ".join(f"p{i}" for i in range(20))
ROWS = [(1, f"a b {P} c"), (2, None), (3, ""), (4, f"{P} tail"), (4, f"{P} tail"), (5, LONG), (6, LONG + " x"), (None, P), (7, " \n\n ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"w": F.lit(1), "n_words": F.lit("clash"), "score": F.lit(None).cast("string"), "h": F.lit(2)}).repartition(3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def _count(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_every_row_stays_and_empty_tables_work(spark, docs):
    items = spark.createDataFrame([(1, P), (2, None), (None, "tail")], "item_id long, text string")
    want = _count(docs)
    for df in (docs, docs.limit(0)):
        n = want if df is docs else []
        assert _count(decontamination.find_contamination(df, items)) == n
        assert _count(licenses.scan_licenses(df)) == n
        assert _count(lines.dedup_lines(df)) == n
        assert _count(simhash.near_duplicates(df)) == n
        assert _count(pii.find_pii(df)) == n
        assert _count(substrings.dedup_substrings(df)) == n
        assert _count(segment.encode_samples(df, k=1)) == n
    # The joins that are not broadcast give the same.
    assert sorted(decontamination.find_contamination(docs, items, broadcast_rows=0).collect(), key=str) == sorted(decontamination.find_contamination(docs, items).collect(), key=str)
    marked = docs.unionByName(docs.withColumn("text", F.lit("x under the MIT license y")))
    assert sorted(licenses.scan_licenses(marked, broadcast_rows=0).collect(), key=str) == sorted(licenses.scan_licenses(marked).collect(), key=str)
    assert decontamination.find_contamination(docs, items.limit(0)).where(F.size("spans") > 0).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, P), (None, "tail")], "item_id long, text string")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7]


def test_lines_judge_the_input(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, f"{a}\nshort"), (2, f"{a} eleven\nother words stand here"), (3, f"{a} eleven twelve\nshort"), (None, None)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{a}\nshort", 2: "other words stand here", 3: "", None: None}


@pytest.mark.parametrize("options", [{}, {"blocks": 1, "leaf": 10}, {"blocks": 2, "leaf": 4}, {"chunk": 3}, {"blocks": 5, "leaf": 3}, {"leaf": 2, "sample": 9}])
def test_simhash_search_is_exact(spark, options):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 30, dtype=np.int64)
    fps = np.unique(np.concatenate([base] + [base ^ (1 << rng.integers(0, 62, 30)) ^ (1 << rng.integers(0, 62, 30)) for _ in range(4)]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), **options)
    got = dict(simhash.components(edges).collect())
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = fps.copy()
    for _ in range(40):
        label = np.array([label[row].min() for row in near])
    assert {int(x): got.get(int(x), int(x)) for x in fps} == {int(x): int(y) for x, y in zip(fps, label, strict=True)}


def test_top_k_handles_bad_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (50, [0.5, -1.0]), (5, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = v.withColumn("score", F.lit("clash"))
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
    twice = v.where("vec_id = 0").unionAll(v.where("vec_id = 0")).unionAll(spark.createDataFrame([(0, [-1.0, 0.0], "")], v.schema))
    assert sorted(tuple(r) for r in topk.top_k(twice, v, k=1).collect()) == [(0, 1, 1, 327680), (0, 1, 50, -32768)]
    got = [tuple(r) for r in topk.top_k(v.where("vec_id % 50 = 0"), v, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 1, 327680), (50, 1, 0, -98304), (50, 2, 1, -98304)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_pii_equals_the_patterns():
    rng = np.random.default_rng(2)
    cues = pii.automaton()
    for _ in range(400):
        t = "".join(rng.choice(list("a@.+-1 2(3)4é\n"), 60)) + " 4111 1111 1111 1111 x@y.zz"
        want = []
        for kind, p in PATTERNS.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and pii._luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                    want.append((kind, m.start(), m.end()))
        assert [s for s in pii.spans_of(t, cues) if s[0] in PATTERNS] == want


@pytest.mark.parametrize("module, score, fit, label", [(quality, quality.score_quality, quality.fit_quality, "quality"), (toxicity, toxicity.score_toxicity, toxicity.fit_toxicity, "toxic")])
def test_classifiers_hold_out(spark, docs, module, score, fit, label):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(d, labels.where(~held))
    got = score(d.select("doc_id", "text"), model).join(labels.where(held), "doc_id").select("score", label).collect()
    assert np.mean([(r[0] >= 0.5) == r[1] for r in got]) > 0.9
    assert all(0 <= r[0] <= 1 for r in score(docs.select("doc_id", "text"), model).select("score").collect())
    assert score(d.select("text"), fit(d, labels.limit(0))).select("score").distinct().count() == 1
    assert zlib.crc32(b"12") == spark.sql("SELECT crc32('12')").first()[0]


def test_toxicity_folds_and_excepts():
    m = toxicity.ToxicityModel({" idiot ": 3.0}, ["idiot proof"], np.array([1.0, 0, 0, 0, -1.0]))
    assert [f[0] for f in toxicity._features(["an 1d!0t.", "іdiоt", "idiot proof", "fine", ""], m)] == [3, 3, 0, 0, 0]


def test_segment_draws_without_replacement():
    v = segment.vocabulary(segment.MODEL)
    keys = segment._mix(np.arange(4000, dtype=np.uint64))
    got = list(segment.sample_runs(["the ab"] * 4000, keys, v, k=2, alpha=1.0))
    pairs = [list(g) for _, g in itertools.groupby(got, key=lambda r: r[0])]
    assert all(len(p) == 2 and not np.array_equal(p[0][2], p[1][2]) and p[0][4] >= p[1][4] for p in pairs)
    assert all(segment.decode_ids(r[2].tolist(), v) == "the ab" for r in got)
    # Inclusion scores make unbiased estimates: the probabilities sum to 1.
    assert abs(sum(math.exp(r[3]) / r[5] for r in got) / 4000 - 1) < 0.03


@pytest.mark.parametrize("text", ["", "a▁b  c\n\td 😀", " lead", "x" * 500, "\u0000 é"])
def test_segment_round_trip(text):
    v = segment.vocabulary(segment.MODEL)
    for r in segment.sample_runs([text], np.array([5], np.uint64), v, k=3, alpha=1.0):
        assert segment.decode_ids(r[2].tolist(), v) == text
