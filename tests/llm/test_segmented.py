import corpus_pipeline
from tracelake.llm import segment


def test_stage_returns_the_pieces(spark):
    rows = [(1, "the cat  sat"), (2, ""), (3, "Größe\nüber alles")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.segmentation(spark, docs, "").collect()
    v = segment.vocabulary(segment.MODEL)
    assert {r.doc_id for r in got} == {1, 2, 3}
    assert all(segment.decode_ids(r.ids, v) == dict(rows)[r.doc_id] and r.round_trip and r.log_prob <= 0 and r["rank"] is not None for r in got)
