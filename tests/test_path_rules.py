"""Path rules: triples are stored without being dealt anew, and triples that are said more than once make no more rows."""

from pyspark.sql import functions as F

from tests.compare import same
from tracelake.operators import paths
from tracelake.plans import paths as plan

SF = "/root/testdata/sf0.001"


def test_repeated_triples_make_no_more_rows(spark, monkeypatch):
    rows, plans = [], []

    def stored(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = store(df, **options)
        rows.append(out.count())
        return out

    store = paths.stored
    monkeypatch.setattr(paths, "stored", stored)
    t = plan.triples(spark, SF)
    once = sorted(map(tuple, paths.violations(t).collect()))
    made, rows = rows, []
    again = sorted(map(tuple, paths.violations(t.crossJoin(spark.range(3)).select("s", "p", "o")).collect()))
    assert once == again and len(set(again)) == len(again)
    assert 3 * made[0] == rows[0] and made[1:] == rows[1:]
    assert "Exchange" not in plans[0]


def test_bits_of_nodes_and_pairs(spark):
    t = [("e", "type", "Eval"), ("e", "type", "Decision"), ("e", "target", "w"), ("w", "type", "Workflow"), ("e", "hasBranch", "b"), ("e", "hasBranch", "b"), ("b", "on", "PASS"), ("f", "next", "x")]
    t += [("s", "type", "Step"), ("s", "usesTool", "[[t]]"), ("u", "usesTool", "[[t]]"), ("a", "type", "Artifact"), ("a", "consumes", "s"), ("a", "check", "e"), ("s", "produces", "a"), (None, "type", "Eval"), (None, "target", "w")]
    got = {(r.rule, r.focus) for r in paths.violations(spark.createDataFrame(t, "s string, p string, o string")).collect()}
    lone = {(x, None) for x in ("eval-artifact", "eval-target", "eval-pass-terminal", "eval-branches")}
    assert got == lone | {("eval-artifact", "e"), ("eval-consumes", "e"), ("eval-branches", "e"), ("decision-branches", "e"), ("eval-fail-evolves", "e"), ("artifact-consumed-by-eval", "a")}


def test_larger_orders_of_shifted_keys_equal_the_sql(spark, tmp_path):
    more = spark.range(2).select(F.col("id").alias("i"))
    for name, keys in (("orders", ("o_orderkey", "o_custkey")), ("lineitem", ("l_orderkey", "l_partkey"))):
        t = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(more)
        t.withColumns({k: (F.col(k) + F.col("i") * 100_003).cast("bigint") for k in keys}).drop("i").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part-*")).rename(tmp_path / f"{name}.parquet")
    same(spark, plan.QUERIES["con9_path_rules"], plan.ORACLE_SQL["con9_path_rules"], str(tmp_path))
