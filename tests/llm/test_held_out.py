"""Recall and precision of the rarer class in each query's own held-out fold; a constant answer has neither."""

import pytest

from tracelake.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, rare, recall, precision", [(quality.op7_quality, "quality", 0, 0.93, 0.88), (toxicity.op8_toxicity, "toxic", 1, 0.85, 0.95)])
def test_rarer_class(spark, query, label, rare, recall, precision):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} IS NOT NULL").select("doc_id", label)
    got = query(spark, SF).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    hit = sum(r.predicted == rare == r[1] for r in got)
    assert hit >= recall * sum(r[1] == rare for r in got) and hit >= precision * sum(r.predicted == rare for r in got), (hit, sum(r[1] == rare for r in got), sum(r.predicted == rare for r in got))
    assert sum(r[1] == rare for r in got) > 40
