from tracelake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_views_and_targets_cover_whole_tables(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    workflows = {r[0] for r in orders.select("o_orderpriority").distinct().collect()}
    assert {r.workflow for r in QUERIES["grf8_stream_view"](spark, SF).collect()} == workflows
    assert {r.workflow for r in QUERIES["grf18_mismatches"](spark, SF).collect()} == workflows
    customers = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert customers <= {r.key for r in QUERIES["join9_paired"](spark, SF).collect()}
