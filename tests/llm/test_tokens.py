"""Token counts against the library's encoding of the whole text."""

import random

import public_tokenizers
import pytest

from tracelake.llm import tokens

SF = "/root/testdata/sf0.001"
ATOMS = ["a", "e", "the", " ", "  ", "\n", "\t", " \n", " ", " ", "　", "\x1c", "\x85", "'s", "'re", "'ll", "'", "''", "é", "日本", "\U0001f600", "<|endoftext|>", "<|endof", "text|>",
         "!!", "...", "123", "７", "​", "x" * 5, "ab", "\r\n", "ß", "́", "_", "-"]


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path(tokens.VOCABULARY), encoding="utf-8") as f:
        return tokens.Counter(f.read())


def whole(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(4))
def test_texts_of_all_kinds(counter, seed):
    rnd = random.Random(seed)
    for _ in range(300):
        t = "".join(rnd.choice(ATOMS) * rnd.choice([1, 1, 1, 2, rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 60)))
        want = whole(counter, t)
        assert counter.count([t]) == [want], t
        assert tokens.count_long(counter.tokenizer, t, rnd.choice([70, 90, 150, 300]), rnd.choice([33, 40, 64])) == want, t


def test_words_longer_than_chunks(counter):
    rnd = random.Random(5)
    for letters in ("a", "ab", "the", "éa", "=-", "0123", " ", "aeiourst"):
        for _ in range(20):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randint(500, 4000)))
            assert tokens.count_long(counter.tokenizer, t, 400, 100) == whole(counter, t), t


def test_chunks_widen_when_they_share_no_cut(counter, monkeypatch):
    widths, cut = [], tokens.splice
    monkeypatch.setattr(tokens, "splice", lambda a, b, after: widths.append(a.end - b.start) or cut(a, b, after))
    t = "word " * 50 + "9" * 700 + " word" * 400
    assert tokens.count_long(counter.tokenizer, t, 300, 40) == whole(counter, t)
    assert max(widths) > 40 > 0


def test_kept_counts_are_bounded(counter, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    texts = [" ".join(f"w{i}x{k}" for i in range(30)) for k in range(20)]
    for t in texts:
        assert counter.count([t]) == [whole(counter, t)] and len(counter.kept) <= 60


def test_query(spark, counter, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (4, "c"), (None, "x y z"), (5, "One two, three.\n" * 9000), (6, "z" * 40_000), (7, "<|endoftext|>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, len((t or "").encode()), n := whole(counter, t or ""), n > 1024) for i, t in rows]
    assert sorted(map(tuple, tokens.op12_token_counts(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.op12_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id] == (len((r.text or "").encode()), whole(counter, r.text or ""))


def test_other_columns_stay(spark):
    d = spark.createDataFrame([("a b", 7, "k")], "body string, n_tokens int, counter string")
    assert [tuple(r) for r in tokens.count_tokens(d, text="body").collect()] == [("a b", 2, "k")]
    assert tokens.count_tokens(d.limit(0), text="body").count() == 0
