"""Schemas of the logs and the views that stand for them over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = (
    "type STRING, turn_id STRING, session_id STRING, timestamp TIMESTAMP, utterance STRING, resolved_intent_id STRING, "
    "resolved_target_entity_id STRING, resolved_target_concepts ARRAY<STRING>, slots_filled STRING, reprompt_count INT, "
    "success BOOLEAN, duration_ms INT, prev_turn_id STRING"
)
ENTRIES = (
    "id STRING, type STRING, title STRING, text STRING, tags ARRAY<STRING>, created_at STRING, source_path STRING, "
    "author STRING, relations ARRAY<STRUCT<type:STRING, target:STRING>>, metadata MAP<STRING,STRING>"
)
AS_OF = "2024-01-31"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: SQL that Spark and DuckDB both run. One row per event; an error has no intent.
TURNS_SQL = """SELECT event_id AS turn_id, user_id AS session_id, ts AS timestamp, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS resolved_intent_id,
  value >= 20 AS success, k % 3 AS reprompt_count, CAST(floor(value * 10) AS INT) AS duration_ms, k, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_turn_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn log of the events table, with an array of concepts that may be empty or hold nulls."""
    t = spark.sql(TURNS_SQL.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))
    k = F.col("k")
    concepts = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("c"), k % 4), F.when(k % 7 != 0, F.concat(F.lit("d"), k % 3)))
    )
    return t.withColumn("resolved_target_concepts", concepts)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), F.col("text").alias("utterance"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an entry. Every 50th is a release note, a fourth of these a roll-back; relations are by arithmetic on the id."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = F.when(i % 50 == 0, "release-note").when(i % 11 == 0, "trouble").when(i % 3 == 0, "user-decision").otherwise("episode")
    rel = lambda name, target: F.struct(F.lit(name).alias("type"), F.concat(F.lit("E-"), target.cast("long")).alias("target"))
    return d.select(
        F.concat(F.lit("E-"), i).alias("id"), kind.alias("type"), F.col("lang"), F.col("source"), F.lpad(i.cast("string"), 12, "0").alias("created_at"), "text",
        F.array_compact(F.array(
            F.when(i % 7 == 0, rel("references", i + 1)),
            F.when((i % 3 == 0) & (i % 50 != 0), rel("invalidated-by", F.floor(i / 50) * 50)),
            F.when((i % 17 == 0) & (i % 50 != 0), rel("verified-in", F.floor(i / 50) * 50)),
            F.when((i % 50 == 0) & (i % 4 == 0) & (i > 0), rel("rolls-back", i - 50)),
            F.when(i % 13 == 0, rel("resolved-by", i + 2)),
        )).alias("relations"),
        F.when(i % 50 == 0, F.map_from_arrays(F.array(F.lit("kind"), F.lit("released_at")), F.array(F.when(i % 200 == 0, "rollback").when(i % 100 == 50, "release"), F.when(i % 3 == 0, F.lpad((i * 7 % 1000003).cast("string"), 12, "0"))))).alias("metadata"),
    )


ENTRIES_SQL = """SELECT 'E-' || doc_id AS id, doc_id AS i, CASE WHEN doc_id % 50 = 0 THEN 'release-note' WHEN doc_id % 11 = 0 THEN 'trouble' WHEN doc_id % 3 = 0 THEN 'user-decision' ELSE 'episode' END AS type, lang, source, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS created_at, text,
  CASE WHEN doc_id % 200 = 0 THEN 'rollback' WHEN doc_id % 100 = 50 THEN 'release' END AS note_kind, CASE WHEN doc_id % 50 = 0 AND doc_id % 3 = 0 THEN lpad(CAST(doc_id * 7 % 1000003 AS VARCHAR), 12, '0') END AS released_at FROM documents"""
RELATIONS_SQL = """SELECT 'E-' || doc_id AS src, 'references' AS kind, 'E-' || (doc_id + 1) AS dst FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 'E-' || doc_id, 'invalidated-by', 'E-' || (doc_id // 50 * 50) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 50 <> 0
  UNION ALL SELECT 'E-' || doc_id, 'verified-in', 'E-' || (doc_id // 50 * 50) FROM documents WHERE doc_id % 17 = 0 AND doc_id % 50 <> 0
  UNION ALL SELECT 'E-' || doc_id, 'rolls-back', 'E-' || (doc_id - 50) FROM documents WHERE doc_id % 50 = 0 AND doc_id % 4 = 0 AND doc_id > 0
  UNION ALL SELECT 'E-' || doc_id, 'resolved-by', 'E-' || (doc_id + 2) FROM documents WHERE doc_id % 13 = 0"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, line, value): events as raw JSON lines of four scopes; every 97th is cut off."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    record = F.to_json(F.struct(
        i.cast("string").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("event_type"),
        F.when(i % 4 != 0, F.concat(F.lit("wf-"), i % 6)).alias("workflow"), F.struct(F.when(i % 5 == 0, F.concat(F.lit("n-"), i % 9)).alias("node_id")).alias("metadata"),
    ))
    scope = F.element_at(F.array(*map(F.lit, ("memory", "audit", "worklog", "intent"))), (i % 4 + 1).cast("int"))
    return e.select(scope.alias("scope"), i.alias("line"), F.when(i % 97 == 0, F.substring(record, 1, 9)).otherwise(record).alias("value"))


LOGS_SQL = """SELECT CASE event_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'audit' WHEN 2 THEN 'worklog' ELSE 'intent' END AS scope, CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, event_type, CASE WHEN event_id % 4 <> 0 THEN 'wf-' || (event_id % 6) END AS workflow,
  CASE WHEN event_id % 5 = 0 THEN 'n-' || (event_id % 9) END AS node FROM events WHERE event_id % 97 <> 0"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, kind, dst): an order consumes parts and produces for its customer."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    eaten = li.select(F.concat(F.lit("part/"), "l_partkey").alias("src"), F.lit("consumed_by").alias("kind"), F.concat(F.lit("run/"), "l_orderkey").alias("dst"))
    made = o.select(F.concat(F.lit("run/"), "o_orderkey").alias("src"), F.lit("produces_to").alias("kind"), F.concat(F.lit("customer/"), "o_custkey").alias("dst"))
    return eaten.unionByName(made)


STREAMS_SQL = """SELECT 'part/' || l_partkey AS src, 'consumed_by' AS kind, 'run/' || l_orderkey AS dst FROM lineitem
  UNION ALL SELECT 'run/' || o_orderkey, 'produces_to', 'customer/' || o_custkey FROM orders"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workflow"), F.concat(F.lit("run/"), "o_orderkey").alias("node"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artifacts; confidence from the price, null for a quarter of the sizes."""
    p = read(spark, sf_dir, "part")
    confidence = F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice") / 2000)
    return p.select(
        F.concat(F.lit("part/"), "p_partkey").alias("id"), confidence.alias("confidence"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50).alias("coverage"),
        F.when(~(F.col("p_size") % 6).isin(0, 3, 5), F.lit("ok")).alias("validation"), F.when(F.col("p_size") % 5 != 0, F.lit("m")).alias("method"), F.when(F.col("p_size") % 8 != 4, F.lit("a")).alias("author"),
        F.when(F.col("p_size") % 12 != 0, F.lit("v1")).alias("version"), F.when(F.col("p_size") % 4 != 0, F.lit("2024")).alias("timestamp"),
    )


ARTIFACTS_SQL = """SELECT 'part/' || p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN p_retailprice / 2000 END AS confidence, CASE WHEN p_size % 3 <> 0 THEN p_size / 50 END AS coverage,
  CASE WHEN p_size % 6 NOT IN (0, 3, 5) THEN 'ok' END AS validation, CASE WHEN p_size % 5 <> 0 THEN 'm' END AS method, CASE WHEN p_size % 8 <> 4 THEN 'a' END AS author,
  CASE WHEN p_size % 12 <> 0 THEN 'v1' END AS version, CASE WHEN p_size % 4 <> 0 THEN '2024' END AS timestamp FROM part"""
#: Customers' and suppliers' nations met in one order: a control graph with cycles.
CONTROL_SQL = """SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey % 5 = s_nationkey % 5 AND (c_nationkey + s_nationkey) % 3 <> 0"""


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTROL_SQL.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}").replace("JOIN lineitem", "JOIN {l}").replace("JOIN supplier", "JOIN {s}"),
                     o=read(spark, sf_dir, "orders"), c=read(spark, sf_dir, "customer"), l=read(spark, sf_dir, "lineitem"), s=read(spark, sf_dir, "supplier"))
