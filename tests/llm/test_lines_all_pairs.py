"""Line dedup against all pairs, on lines of every length, in crowds of near copies and with letters outside ASCII."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(line):
    return {w for w in "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in line.translate(LOWER)).split()}


def _brute(rows):
    seen, gone = [], []
    for i, text in rows:
        for no, line in enumerate(text.split("\n")):
            s = _words(line)
            if any(s and 5 * len(s & t) >= 4 * len(s | t) for t in seen):
                gone.append((i, no))
            seen.append(s)
    return sorted(gone)


@pytest.mark.parametrize("crowd", [2, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_removed_lines_equal_all_pairs(spark, seed, crowd, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", crowd)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "À", "Ã", "ã", "ﬀ", "Σ", "Дом", "дом", "日本", "İ"]
    seeds = [[r.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 10, 20, 70, 90, 150) for _ in range(2)]
    rows = []
    for i in range(60):
        made = []
        for _ in range(6):
            w = list(r.choice(seeds))
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 6])):
                w[r.randrange(len(w))] = r.choice([*vocabulary, f"new{r.random()}"])
            made.append(r.choice([" ", ", ", "  ", "-"]).join(r.choice([x, x.upper() if x.isascii() else x]) for x in w))
        rows.append((i, "\n".join(made)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((x.doc_id, x.line_no) for x in lines.removed_lines(df).collect())
    assert got == _brute(rows)
    assert len(got) > 50


def test_very_long_text_and_hot_line(spark):
    long = "\n".join(f"a{i} b{i} c{i} d{i} e{i}" for i in range(20_000))
    docs = spark.createDataFrame([(0, long), (1, long + "\nmore")] + [(i, "hot line here") for i in range(2, 300)] + [(None, "hot line here")], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(docs.withColumn("n", F.lit("clash")), removed="cid").collect()}
    assert got[0].text == long and got[1].text == "more" and len(got[1].cid) == 20_000
    assert got[None].text == "hot line here" and got[2].text == "" and all(r.n == "clash" for r in got.values())
