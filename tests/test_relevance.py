import random
import re

from tracelake.operators import memory

ENTRY = "id string, type string, title string, text string, tags array<string>, module string, created_at string"


def _tokens(*parts):
    return {t.lower() for t in re.findall(r"[A-Za-z0-9_.-]{3,}", " ".join(p for p in parts if p))}


def _brute(nodes, entries, k):
    out = set()
    for node, text, tags, types in nodes:
        mine, scored = {t.lower() for t in tags}, []
        for i, kind, title, body, own, module, at in entries:
            if types and kind not in types:
                continue
            score = memory.TYPE_PRIORITIES.get(kind, 0) + 18 * len(mine & {t.lower() for t in own}) + len(_tokens(text) & _tokens(i, kind, title, body, *own))
            scored.append((-(score + (12 if module and module.lower() in mine else 0)), at or "", i))
        out |= {(node, i, -s, r) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_relevance_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{x}" for x in range(40)]
    pick = lambda n: " ".join(rng.choices(words, k=n))
    kinds = ["principle", "user-decision", "episode", "trouble", None]
    entries = [(f"E-{x}", rng.choice(kinds), rng.choice([None, pick(1)]), pick(rng.randint(0, 4)), rng.sample(["Aa", "bb", "cc"], rng.randint(0, 2)), rng.choice([None, "", "AA", "dd"]), rng.choice([None, f"{x % 7}"])) for x in range(120)]
    nodes = [(x, pick(rng.randint(0, 6)), rng.sample(["aa", "BB", "dd"], rng.randint(0, 3)), rng.choice([None, [], ["trouble", "episode"]])) for x in range(30)]
    got = memory.relevance(spark.createDataFrame(nodes, "node int, text string, tags array<string>, types array<string>"), spark.createDataFrame(entries, ENTRY), k=5)
    assert {tuple(r) for r in got.collect()} == _brute(nodes, entries, 5)


def test_a_shared_tag_without_a_shared_token_counts(spark):
    nodes = spark.createDataFrame([("n", "alpha beta", ["en"], None)], "node string, text string, tags array<string>, types array<string>")
    entries = spark.createDataFrame([("E-1", "x", None, "alpha", [], None, "2"), ("E-2", "x", None, "gamma", ["EN"], None, "3"), ("E-3", "x", None, "", [], "en", "1")], ENTRY)
    assert [(r.id, r.score) for r in memory.relevance(nodes, entries, k=2).orderBy("rank").collect()] == [("E-2", 18), ("E-3", 12)]
