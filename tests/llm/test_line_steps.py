"""Steps of line dedup: what stands between words, sort keys, and crowds of which only the members are ordered."""

from pyspark.sql import functions as F

from tracelake.llm import lines
from tracelake.llm.common import GAP


def test_gaps_are_those_of_words(spark):
    chars = [chr(c) for c in [*range(128), *range(128, 600), 0x2028, 0x3000, 0xFF11, 0x1F600] if not 65 <= c <= 90]
    df = spark.createDataFrame([(f"a{c}b",) for c in chars], "x string")
    assert df.where(F.split("x", GAP) != F.split("x", lines._BETWEEN)).count() == 0


def test_only_members_of_crowds_are_ordered(spark, monkeypatch):
    made = []

    def stored(df, **options):
        out = store(df, **options)
        made.append(out)
        return out

    store = lines.stored
    monkeypatch.setattr(lines, "stored", stored)
    monkeypatch.setattr(lines, "discard", lambda *tables: None)
    crowd = [(i, f"alpha beta gamma delta epsilon zeta eta theta iota new{i}") for i in range(40)]
    docs = spark.createDataFrame([*crowd, *[(100 + i, f"p{i} q{i} r{i} s{i} t{i}") for i in range(200)]], "doc_id long, text string")
    assert sorted(r.doc_id for r in lines.removed_lines(docs).collect()) == list(range(1, 40))
    crowds = [t for t in made if t.columns == ["k"]]
    assert len(crowds) == 1 and crowds[0].count() <= 2


def test_plans_are_kept_as_short_texts(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    n = store.executionsList().size()
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "five four three two one\none two three four five six")], "doc_id long, text string")
    assert lines.removed_lines(docs).count() == 2
    ran = store.executionsList()
    assert ran.size() > n
    assert max(len(ran.apply(i).physicalPlanDescription()) for i in range(n, ran.size())) < 100_000
