from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import decontamination, simhash, toxicity
from tracelake.llm.fitting import fold

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, SF).cache()
        if name != "segmentation":
            assert kept.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0))
            bad = {r.doc_id for r in toxicity.score_toxicity(before, model).where("score >= 0.5").collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()} == bad
        if name == "line_dedup":
            assert kept.count() == before.count()
        if name == "near_dedup":
            fps = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
            left = sorted(r.doc_id for r in kept.collect())
            assert all((fps[a] ^ fps[b]).bit_count() > 4 for a in left for b in left if a < b)
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            hit = {r.doc_id for r in decontamination.find_contamination(before, items).where(F.size("spans") > 0).collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()} == hit
        if name == "segmentation":
            assert kept.where("NOT round_trip").count() == 0
