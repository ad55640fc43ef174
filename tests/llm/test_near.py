import numpy as np

import corpus_pipeline
from tracelake.llm import near, simhash

SF = "/root/testdata/sf0.001"


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def _brute(rows):
    """doc_id -> smallest doc_id of its component, by all pairs."""
    sets, fps = [_sets(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
    label = [i for i, _ in rows]

    def linked(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and sets[a] or (fps[a] ^ fps[b]).bit_count() <= 4

    links = [(a, b) for a in range(len(rows)) for b in range(a) if linked(a, b)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return dict(zip([i for i, _ in rows], label, strict=True))


def _texts():
    rng = np.random.default_rng(4)
    rows, common = [], [f"c{x}" for x in range(30)]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(4, 150)))]
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = "new" + str(rng.integers(0, 99))
            rows.append(" ".join(w + (common if rng.random() < 0.3 else [])))
    return list(enumerate(rows + ["", None, "one", "one two", "one two three four five", "One  two three four five"]))


def test_groups_equal_brute_force(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near.near_groups(docs).collect()}
    assert got == _brute(rows)
    assert near.near_groups(docs.limit(0)).count() == 0


def test_stage_drops_what_shares_most_shingles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = " ".join(f"u{i}" for i in range(90))
    # One word in the middle takes 5 of 86 shingles: Jaccard 81 / 91, more than 4 bits apart.
    near_copy = base.replace(" u45 ", " other ")
    assert (simhash.fingerprint(base) ^ simhash.fingerprint(near_copy)).bit_count() > 4
    two = spark.createDataFrame([(900_001, base), (900_002, near_copy)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(two)
    rows = [tuple(r) for r in docs.collect()]
    want = _brute(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, c in want.items() if i == c)
    assert 900_002 not in {r.doc_id for r in kept}
