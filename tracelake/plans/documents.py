"""Nested workflow documents over the shared tables: each order is a document with groups in groups, some with a workflow in a workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..schemas import read

#: JSON of an order's document. SQL that Spark and DuckDB both run.
VALUE_SQL = """CASE WHEN o_orderkey % 50 = 7 THEN 'no json' ELSE '{"project":"p"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"module":"m' || o_orderkey || '"' ELSE '' END || ',"workflows":[{"id":"w' || o_orderkey || '","nodes":['
  || '{"id":"a","type":"step","owner":"' || o_orderstatus || '","tags":["x","' || o_orderpriority || '"],"directories":[{"path":"in/","role":"input"},{"path":"out/","note":"n"},{"role":"lost"}]},"not a node",{"type":"step"},'
  || '{"id":"g","type":"group","steps":[{"id":"b","type":"Decision","branches":[{"on":"yes","goto":"' || CASE WHEN o_orderkey % 4 < 2 THEN 'c' ELSE 'z' END || '"},{"on":"no"},{"goto":"lost"}]}'
  || CASE WHEN o_orderkey % 3 = 0 THEN ',{"id":"h","type":"group","steps":[{"id":"i","type":"step","steps":[{"id":"j","type":"step","n":' || o_custkey || '}]}]}' ELSE '' END
  || ',{"id":"c","type":"eval","branches":[{"on":"fail","goto":"a","label":"back"}]}]},'
  || '{"id":"d","type":"validation","branches":[],"narrative":{"why":{"z":[1,{"y":2,"b":"t"}],"a":' || o_custkey || '}},"empty":null,"mixed":[{"k":1},2]},{"id":"e","type":"step"}]'
  || CASE WHEN o_orderkey % 5 = 0 THEN ',"workflows":[{"id":"sub","steps":[{"id":"s1","type":"step"},{"id":"s2","type":"step"}]}]' ELSE '' END || '}]}' END"""


def _walk(spark, d):
    """A document is some hundred times as long as the row that it is made of, so the rows are dealt to all cores first: few large files would keep few cores busy."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition(4 * spark.sparkContext.defaultParallelism)
    return D.walk(rows.selectExpr("'doc/' || o_orderkey AS doc", f"{VALUE_SQL} AS value"))


QUERIES = {
    "etl1_nested_workflows": lambda s, d: _walk(s, d)[0].select("doc", "workflow", "parent"),
    "etl1_nested_nodes": lambda s, d: _walk(s, d)[1].select("workflow", "id", "parent", "type", F.array_join("place", ".").alias("place")),
    "etl1_nested_branches": lambda s, d: D.branches(_walk(s, d)[1]),
    "etl1_nested_nexts": lambda s, d: D.nexts(_walk(s, d)[1]),
    "etl1_nested_fields": lambda s, d: D.fields(_walk(s, d)[1]),
    "etl1_nested_directories": lambda s, d: D.directories(_walk(s, d)[1]),
}
_S = f"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'm' ELSE 'w' END || o_orderkey AS sc, o_orderkey % 3 = 0 AS deep FROM (SELECT *, 'doc/' || o_orderkey AS doc FROM orders) WHERE o_orderkey % 50 <> 7),
 n AS (SELECT o.*, CASE WHEN v.wf = '' THEN 'w' || o_orderkey ELSE v.wf END wf, v.id, v.parent, v.type, CASE WHEN v.id = 'c' AND deep THEN '0.3.2' ELSE v.place END place FROM o, (VALUES ('', 'a', NULL, 'step', '0.0'), ('', 'g', NULL, 'group', '0.3'), ('', 'b', 'g', 'Decision', '0.3.0'), ('', 'h', 'g', 'group', '0.3.1'), ('', 'i', 'h', 'step', '0.3.1.0'),
  ('', 'j', 'i', 'step', '0.3.1.0.0'), ('', 'c', 'g', 'eval', '0.3.1'), ('', 'd', NULL, 'validation', '0.4'), ('', 'e', NULL, 'step', '0.5'), ('sub', 's1', NULL, 'step', '0.0.0'), ('sub', 's2', NULL, 'step', '0.0.1')) v(wf, id, parent, type, place)
  WHERE (deep OR v.id NOT IN ('h', 'i', 'j')) AND (v.wf = '' OR o_orderkey % 5 = 0)),
 f AS (SELECT 'node/' || sc || '/' src, * FROM o)"""
ORACLE_SQL = {
    "etl1_nested_workflows": _S + " SELECT doc, 'workflow/' || sc || '/w' || o_orderkey workflow, NULL::VARCHAR parent FROM o UNION ALL SELECT doc, 'workflow/' || sc || '/sub', 'workflow/' || sc || '/w' || o_orderkey FROM o WHERE o_orderkey % 5 = 0",
    "etl1_nested_nodes": _S + " SELECT 'workflow/' || sc || '/' || wf workflow, 'node/' || sc || '/' || id AS id, 'node/' || sc || '/' || parent AS parent, type, place FROM n",
    "etl1_nested_branches": _S + """ SELECT src || 'b' src, 'yes' AS "on", src || CASE WHEN o_orderkey % 4 < 2 THEN 'c' ELSE 'z' END dst, NULL::VARCHAR AS label FROM f UNION ALL SELECT src || 'b', 'no', NULL, NULL FROM f UNION ALL SELECT src || 'c', 'fail', src || 'a', 'back' FROM f""",
    "etl1_nested_nexts": _S + """ SELECT src || a src, src || b dst FROM f, (VALUES ('a', 'g'), ('g', 'b'), ('b', 'h'), ('h', 'i'), ('i', 'j'), ('j', 'c'), ('b', 'c'), ('d', 'e'), ('s1', 's2')) v(a, b)
  WHERE (deep OR a NOT IN ('h', 'i', 'j') AND b <> 'h') AND NOT (a = 'b' AND b = 'c' AND (deep OR o_orderkey % 4 < 2)) AND (a <> 's1' OR o_orderkey % 5 = 0)""",
    "etl1_nested_fields": _S + """ SELECT src || 'a' AS id, 'owner' AS field, o_orderstatus AS value FROM f UNION ALL SELECT src || 'a', 'tags', unnest(['x', o_orderpriority]) FROM f UNION ALL SELECT src || 'j', 'n', CAST(o_custkey AS VARCHAR) FROM f WHERE deep
  UNION ALL SELECT src || 'd', 'narrative', '{"why":{"a":' || o_custkey || ',"z":[1,{"b":"t","y":2}]}}' FROM f UNION ALL SELECT src || 'd', 'mixed', '[{"k":1},2]' FROM f""",
    "etl1_nested_directories": _S + " SELECT src || 'a' node, 'in/' AS path, 'input' AS role, NULL::VARCHAR note FROM f UNION ALL SELECT src || 'a', 'out/', NULL, 'n' FROM f",
}
