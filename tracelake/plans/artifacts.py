"""Artifacts over the shared tables: parts are artifacts, line items tell which run reads and writes which folder, orders deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import artifacts as A
from ..schemas import read

#: Every marker and every place where one rule goes before another: data_type, locator, source, role, detail, resource_kind, explicit_type.
SAMPLES = [
    ("local_file", "data/model.owl", None, None, None, None, None), ("database", "table:x", None, None, None, None, None), ("", "sqlite_table:runs", "api", None, None, None, None),
    ("local_file", "store/cache.db#runs", None, None, None, None, None), ("API ", "https://x/y.pdf", None, None, None, None, None), ("mcp", "duckdb", None, None, None, None, None),
    ("object_store", "work-memory/", None, None, None, None, None), ("external_url", "a.mp4", None, None, None, None, None), (None, "runs.sqlite", "event log", None, None, None, None),
    (None, "logs/audit-log/ttl", None, None, None, None, None), (None, "worklog/2024", None, None, None, None, None), (None, "shapes/SHACL", "[[tool]]", None, None, None, None),
    (None, "x", None, None, "[[ my process here ]]", None, None), (None, "x", None, "Engine Process", "page.html", None, None), (None, "img/a.jpeg", None, None, None, None, None), (None, "notes.md", None, None, None, None, None),
    (None, "jsonl", None, None, None, "data", None), (None, "duckdb/api", None, None, None, " DATA", None), (None, "notes", None, None, None, "data", None), (None, "a.webp", None, None, None, "file", None),
    (None, "event.owl", None, None, None, "File ", None), (None, "a.pdf", None, None, None, "other", None), (None, "event", None, None, None, None, "Table"), (None, "event", None, None, None, None, "no such"),
    (None, None, None, None, None, None, None), (None, "x#y", "visual-dom", None, None, None, None), (None, "x", None, None, "db_table:z", None, None), (None, "catalog", None, "tool use", None, None, None),
]
_ROWS = ", ".join("(" + ", ".join([str(i), *("NULL" if v is None else f"'{v}'" for v in s)]) + ")" for i, s in enumerate(SAMPLES))
#: SQL that Spark and DuckDB both run.
ARTIFACTS_SQL = f"""SELECT 'part/' || p_partkey AS id, data_type, locator || CASE WHEN p_partkey % 5 = 0 THEN '/' || p_name ELSE '' END AS locator, source, role, detail, resource_kind, explicit_type
  FROM part JOIN (VALUES {_ROWS}) v(i, data_type, locator, source, role, detail, resource_kind, explicit_type) ON p_partkey % {len(SAMPLES)} = i"""
DIRECTORIES_SQL = """SELECT 'run/' || l_orderkey AS node, 'data/' || lower(l_returnflag) || '/' || CASE l_suppkey % 7 WHEN 0 THEN 'events.jsonl' WHEN 1 THEN 'shapes.ttl' WHEN 2 THEN 'runs.sqlite' WHEN 3 THEN 'plot.png' WHEN 4 THEN 'notes.md' ELSE 'x' || l_suppkey END AS path,
  CASE l_partkey % 9 WHEN 0 THEN 'input' WHEN 1 THEN 'Output' WHEN 2 THEN 'staging' WHEN 3 THEN 'style-reference' WHEN 4 THEN 'write' WHEN 5 THEN 'read' WHEN 6 THEN 'scratch' WHEN 7 THEN 'input-output' END AS role,
  CASE WHEN l_suppkey % 11 = 3 THEN 'tool' END AS explicit_type FROM lineitem"""
DELIVERABLES_SQL = "SELECT 'run/' || o_orderkey AS node, CASE WHEN o_custkey % 3 = 0 THEN 'deck-' || o_custkey || ' slides.pptx' WHEN o_custkey % 3 = 1 THEN '' ELSE 'memo-' || o_custkey END AS text FROM orders"


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ARTIFACTS_SQL.replace("FROM part ", "FROM {p} "), p=read(spark, d, "part"))


def _uses(spark, d):
    folders = spark.sql(DIRECTORIES_SQL.replace("FROM lineitem", "FROM {l}"), l=read(spark, d, "lineitem"))
    given = spark.sql(DELIVERABLES_SQL.replace("FROM orders", "FROM {o}"), o=read(spark, d, "orders"))
    s = S.streams(spark, d)
    edges = s.select("src", "dst", F.when(F.col("kind") == "produces_to", "produces").otherwise("consumes").alias("kind"))
    return A.uses(folders, given, edges, S.membership(spark, d).withColumnRenamed("workflow", "scope"))


def _index(spark, d):
    typed = artifacts(spark, d).select("id", F.lower("explicit_type").alias("artifact_type"), "locator")
    return A.artifact_index(typed.join(S.artifacts(spark, d), "id").withColumns({"confidence": F.lit(None).cast("string"), "coverage": F.when(F.col("coverage").isNotNull(), F.lit("some"))}))


QUERIES = {
    "fn7_types": lambda s, d: A.with_types(artifacts(s, d).withColumn("artifact_id", F.lit("p"))).select("id", "artifact_type", "resource_kind", "primary_consumer"),
    "fn9_roles": lambda s, d: _roles(s, d),
    "agg15_members": lambda s, d: A.members(_uses(s, d)),
    "agg15_streams": lambda s, d: A.streams(_uses(s, d)),
    "agg16_report": lambda s, d: A.gaps(_uses(s, d)),
    "agg16_summary": lambda s, d: A.gap_summary(A.gaps(_uses(s, d))),
    "grf20_artifacts": _index,
}


def _roles(spark, d):
    rows = spark.sql(DIRECTORIES_SQL.replace("FROM lineitem", "FROM {l}"), l=read(spark, d, "lineitem")).groupBy("role").agg(F.count("*").alias("n"))
    (p, c, detail), (_, upgraded, _) = A.role_of(F.col("role")), A.role_of(F.col("role"), "upgrade")
    return rows.select("role", "n", p.alias("produces"), c.alias("consumes"), detail.alias("detail"), upgraded.alias("upgrade_consumes"))


def _any(text: str, *kinds: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for k in kinds for m in A.MARKERS[k]) + ")"


#: Type, then kind and consumer; ``h`` is all text, ``n`` a list of the names that may begin like a table.
_TYPE = f"""CASE WHEN explicit IN ('knowledge_store', 'event_store', 'local_database', 'document', 'media', 'tool', 'table') THEN explicit
  WHEN kind = 'data' THEN CASE WHEN {_any("h", "event_store")} THEN 'event_store' WHEN {_any("h", "local_database")} THEN 'local_database' ELSE 'knowledge_store' END
  WHEN kind = 'file' THEN CASE WHEN {_any("h", "media")} THEN 'media' ELSE 'document' END
  WHEN dt = 'database' THEN 'local_database' WHEN len(list_filter(n, lambda x: regexp_matches(x, '^(table|sqlite_table|db_table):'))) > 0 OR contains(h, '#') AND {_any("h", "local_database")} THEN 'table'
  WHEN dt IN ('api', 'mcp', 'object_store', 'external_url') THEN 'knowledge_store' WHEN {_any("h", "local_database")} THEN 'local_database' WHEN {_any("h", "event_store")} THEN 'event_store' WHEN {_any("h", "knowledge_store")} THEN 'knowledge_store'
  WHEN {_any("h", "tool")} OR regexp_matches(h, '\\[\\[[^\\]]*(process|tool)[^\\]]*\\]\\]') THEN 'tool' WHEN {_any("h", "media")} THEN 'media' ELSE 'document' END"""
_WHO = "CASE artifact_type WHEN 'document' THEN 'Human + Agent' WHEN 'media' THEN 'Human' WHEN 'tool' THEN 'Agent + Eval' WHEN 'table' THEN 'Tool + Agent' ELSE 'Agent' END"
_NATIVE = "artifact_type IN ('knowledge_store', 'event_store', 'local_database', 'table')"
_ROLE = """coalesce(contains(replace(lower(r), '-', '_'), 'output') OR r IN ('staging', 'write'), false) produces, coalesce(regexp_matches(lower(r), 'input|reference|instruction') OR r IN ('staging', 'read'), false) consumes"""
_U = f"""WITH f AS (SELECT node, 'local_file:' || path artifact, lower(path) h, [lower(path)] n, path detail, coalesce(explicit_type, '') explicit, {_ROLE} FROM (SELECT *, coalesce(role, 'reference') r FROM ({DIRECTORIES_SQL}))),
 g AS (SELECT node, 'deliverable:' || text artifact, lower('deliverable:' || text || ' ' || text) h, [lower(text)] n, text detail, '' explicit, true produces, false consumes FROM ({DELIVERABLES_SQL}) WHERE text <> ''),
 e AS (SELECT CASE kind WHEN 'produces_to' THEN src ELSE dst END node, 'artifact:' || CASE kind WHEN 'produces_to' THEN dst ELSE src END artifact, kind = 'produces_to' p FROM ({S.STREAMS_SQL})),
 a AS (SELECT * FROM f WHERE produces OR consumes UNION ALL SELECT * FROM g UNION ALL SELECT node, artifact, lower(artifact), [artifact], '', '', p, NOT p FROM e),
 u AS (SELECT o_orderpriority AS scope, node, artifact, {_TYPE} AS artifact_type, detail, produces, consumes FROM (SELECT *, '' kind, 'local_file' dt FROM a) JOIN (SELECT 'run/' || o_orderkey node, o_orderpriority FROM orders) USING (node)),
 m AS (SELECT scope, artifact, node, min(artifact_type) artifact_type, min(detail) detail, bool_or(produces) produces, bool_or(consumes) consumes FROM u GROUP BY ALL),
 s AS (SELECT scope, artifact, min(artifact_type) artifact_type, min(detail) detail, count(*) FILTER (produces) producers, count(*) FILTER (consumes) consumers FROM m GROUP BY scope, artifact),
 t AS (SELECT *, CAST(CASE WHEN consumers = 0 THEN sum(consumers) OVER (PARTITION BY artifact) ELSE 0 END AS BIGINT) elsewhere FROM s),
 r AS (SELECT scope, artifact, artifact_type, {_WHO} primary_consumer, detail, CASE WHEN consumers = 0 THEN 'unconsumed' ELSE 'external' END gap, producers + consumers AS nodes, elsewhere,
  CASE WHEN consumers > 0 THEN 'external input (' || artifact_type || ')' WHEN elsewhere > 0 THEN 'cross-workflow ' || artifact_type || ' artifact' WHEN {_NATIVE} THEN 'missing agent consumer for ' || artifact_type
   WHEN artifact_type = 'media' THEN 'terminal media deliverable candidate' ELSE 'terminal/review document candidate' END hint,
  CASE WHEN consumers > 0 THEN NULL WHEN elsewhere > 0 THEN 'link the downstream consumer workflow or split the artifact boundary intentionally'
   WHEN {_NATIVE} THEN 'add an agent consumer task, mark as external artifact output, or move it to a workflow that reads it'
   WHEN artifact_type = 'media' THEN 'confirm a human review/delivery consumer exists, otherwise skip the artifact' ELSE 'confirm agent/user consumer; else omit or convert to jsonl/ttl/sqlite' END next_action FROM t WHERE producers = 0 OR consumers = 0)"""
ORACLE_SQL = {
    "fn7_types": f"""WITH p AS (SELECT id, lower(trim(coalesce(explicit_type, ''))) explicit, lower(trim(coalesce(resource_kind, ''))) kind, lower(trim(coalesce(nullif(data_type, ''), 'local_file'))) dt,
  lower(concat_ws(' ', 'p', coalesce(locator, ''), coalesce(source, ''), coalesce(role, ''), coalesce(detail, ''))) h, [lower(coalesce(locator, '')), lower(coalesce(detail, ''))] n FROM ({ARTIFACTS_SQL})),
 q AS (SELECT id, {_TYPE} artifact_type FROM p) SELECT id, artifact_type, CASE WHEN {_NATIVE} THEN 'data' ELSE 'file' END resource_kind, {_WHO} primary_consumer FROM q""",
    "fn9_roles": f"""WITH x AS (SELECT role, count(*) n FROM ({DIRECTORIES_SQL}) GROUP BY role), y AS (SELECT *, replace(lower(role), '-', '_') r FROM x)
 SELECT role, n, contains(r, 'output') OR r IN ('staging', 'generated', 'write') produces, contains(r, 'input') OR contains(r, 'reference') OR contains(r, 'instruction') OR r IN ('staging', 'read') consumes,
  CASE WHEN r IN ('output', 'input', 'reference', 'input_output') THEN '' ELSE role END detail, contains(r, 'input') OR r IN ('reference', 'instruction') upgrade_consumes FROM y""",
    "agg15_members": _U + " SELECT scope, artifact, node, produces, consumes FROM m",
    "agg15_streams": _U + " SELECT * FROM s",
    "agg16_report": _U + " SELECT * FROM r",
    "agg16_summary": _U + """ SELECT gap measure, v AS value, count(r.gap) FILTER (artifact_type = v) n FROM (VALUES ('knowledge_store'), ('event_store'), ('local_database'), ('document'), ('media'), ('tool'), ('table')) k(v) CROSS JOIN r GROUP BY 1, 2
 UNION ALL SELECT 'hint', hint, count(*) FROM r WHERE gap = 'unconsumed' GROUP BY hint""",
    "grf20_artifacts": f"""SELECT p.id, coalesce(lower(explicit_type), 'unspecified') artifact_type, coalesce(locator, '-') locator,
  coalesce(nullif(concat_ws(' · ', 'author: ' || author, 'v: ' || version, 'validated: ' || validation, CASE WHEN coverage IS NOT NULL THEN 'cov: some' END), ''), '—') provenance FROM ({ARTIFACTS_SQL}) p JOIN ({S.ARTIFACTS_SQL}) a ON p.id = a.id""",
}
