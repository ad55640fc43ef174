"""Nulls, empty and long texts, repeats, empty tables and clashing columns for the classifiers and the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import quality, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(40_000))
ROWS = [(-5, None), (-4, ""), (-3, " \n\n "), (-2, "Two words"), (-2, "Two words"), (-1, LONG), (None, "a line of its own\nTwo words"), (None, None)]


@pytest.mark.parametrize("clash", [False, True])
def test_stages_take_any_rows(spark, clash):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(ROWS, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = d.unionByName(more)
    if clash:
        docs = docs.withColumns({"n": F.lit(1), "cid": F.lit("x"), "_score": F.lit(0), "h": F.lit(2), "_id": F.lit(3), "key": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        ids = {r.doc_id for r in got.select("doc_id").collect()}
        if name == "segmentation":
            assert got.where("NOT round_trip").count() == 0 and {None, -5, -1} <= ids
            continue
        assert set(got.columns) == set(docs.columns)
        if name == "line_dedup":
            texts = {(r.doc_id, r.text) for r in got.where("doc_id < 0 OR doc_id IS NULL").collect()}
            assert {(-5, None), (-4, ""), (None, None), (-1, LONG), (None, "a line of its own\nTwo words"), (-2, "")} <= texts and got.count() == docs.count()
        elif name == "near_dedup":
            assert -5 in ids and not {-4, -3} & ids and {-2, -1, None} <= ids and got.where("doc_id = -2").count() == 2
        else:
            assert {-5, -4, -3, -2, -1, None} <= ids and got.where("doc_id = -2").count() == 2


@pytest.mark.parametrize("module, query, out, folds, held", [(quality, quality.op7_quality, "quality", 3, 1), (toxicity, toxicity.op8_toxicity, "toxic", 5, 0)])
def test_queries_hold_their_own_fold_out(spark, module, query, out, folds, held):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    assert got.where(F.col("held_out") != (remainder == held)).count() == 0 and got.where("predicted <> cast(score >= 0.5 AS int) OR score < 0 OR score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = [r[0] == r[1] for r in got.where("held_out").join(labels, "doc_id").select("predicted", out).collect()]
    assert np.mean(right) > 0.9


def test_ties_and_repeats(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    even = toxicity.ToxicityModel({}, [], np.zeros(5))
    assert [r.score for r in toxicity.score_toxicity(d, even).collect()] == [0.5] * 4
    assert {r.score for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect()} == {1.0}
    assert quality.score_quality(d, quality.fit_quality(d, labels)).count() == 4
