"""Node tables and orders over the shared tables: priorities are phases and workflows, orders nodes, line items branches and control edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflow as W
from ..schemas import read

#: SQL that Spark and DuckDB both run.
TRIPLES_SQL = """WITH o AS (SELECT *, 'https://x/wf#node/' || o_orderstatus || '/n ' || o_orderkey AS node, 'https://x/wf#phase/' || o_orderpriority AS phase FROM orders), l AS (SELECT *, 'https://x/wf#branch/' || l_orderkey || '.' || l_linenumber AS b FROM lineitem)
 SELECT node AS s, 'type' AS p, CASE o_orderkey % 5 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Validation' WHEN 2 THEN 'Group' WHEN 3 THEN 'Other' ELSE 'Step' END AS o FROM o UNION ALL SELECT node, 'type', 'Step' FROM o WHERE o_orderkey % 5 < 2 AND o_custkey % 3 = 0
 UNION ALL SELECT phase, 'type', 'Phase' FROM o UNION ALL SELECT phase, 'label', 'phase ' || substr(o_orderpriority, 1, 1) FROM o WHERE o_orderpriority < '4' UNION ALL SELECT phase, 'instruction', 'none of a phase' FROM o
 UNION ALL SELECT phase, 'hasNode', node FROM o WHERE o_orderkey % 11 <> 3 UNION ALL SELECT node, 'label', 'order ' || o_custkey FROM o WHERE o_custkey % 4 <> 0 UNION ALL SELECT node, 'label', '' FROM o WHERE o_custkey % 8 = 0
 UNION ALL SELECT node, 'status', o_orderstatus FROM o WHERE o_custkey % 5 <> 0 UNION ALL SELECT node, 'instruction', 'do ' || o_orderdate FROM o WHERE o_custkey % 3 = 1
 UNION ALL SELECT node, 'judge', CASE o_custkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'human' ELSE 'script' END FROM o WHERE o_orderkey % 5 = 0 AND o_custkey % 7 > 0 UNION ALL SELECT node, 'harness', 'h' || (o_custkey % 3) FROM o WHERE o_orderkey % 5 = 1
 UNION ALL SELECT 'https://x/wf#node/' || o_orderstatus || '/n ' || o_orderkey, 'passCriteria', 'at least ' || l_linenumber FROM l JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber < 4
 UNION ALL SELECT 'https://x/wf#node/' || o_orderstatus || '/n ' || o_orderkey, 'hasBranch', b FROM l JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 5 <> 4
 UNION ALL SELECT b, 'on', CASE l_linenumber % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE '' END FROM l WHERE l_linenumber <> 6 UNION ALL SELECT b, 'goto', ' n ' || l_partkey || '! ' FROM l WHERE l_partkey % 3 <> 0 UNION ALL SELECT b, 'label', 'L' || l_suppkey FROM l WHERE l_suppkey % 2 = 0"""
#: Control edges of five workflows with 14 nodes: forward ones, cycles in the second and fourth, one ring in the fifth.
FLOW_SQL = """SELECT DISTINCT workflow, workflow || '/' || lpad(CAST(k AS VARCHAR(9)), 2, '0') AS src, workflow || '/' || lpad(CAST(CASE WHEN workflow = '5' THEN (k + 1) % 14 WHEN workflow IN ('2', '4') AND k IN (6, 11) AND l_linenumber = 1 THEN k - 3 ELSE k + 1 + s END AS VARCHAR(9)), 2, '0') AS dst
  FROM (SELECT substr(o_orderpriority, 1, 1) AS workflow, l_partkey % 14 AS k, CASE WHEN l_partkey % 14 = 12 THEN 0 ELSE l_suppkey % 2 END AS s, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x WHERE k < 13 OR workflow = '5'"""


def _sql(spark, d, text):
    text = text.replace("FROM orders", "FROM {orders}").replace("JOIN orders", "JOIN {orders}").replace("FROM lineitem", "FROM {lineitem}").replace("VARCHAR(9)", "STRING")
    return spark.sql(text, **{t: read(spark, d, t) for t in ("orders", "lineitem") if f"{{{t}}}" in text})


def _nodes(spark, d):
    routes = spark.createDataFrame([("model", "cloud"), ("human", "desk")], "judge string, provider string")
    defaults = spark.createDataFrame([("phase", "planner"), ("step", "runner"), ("validation", "checker"), ("decision", "unused")], "type string, provider string")
    t = W.node_table(_sql(spark, d, TRIPLES_SQL), routes, defaults)
    told = F.array_join(F.transform("branches", lambda b: F.concat_ws(">", b["on"], b["goto"], b["label"])), ";")
    return t.withColumns({"pass_criteria": F.array_join("pass_criteria", ";"), "branches": told})


def _flow(spark, d):
    edges = _sql(spark, d, FLOW_SQL)
    return edges.select("workflow", F.explode(F.array("src", "dst")).alias("node")).distinct(), edges


QUERIES = {
    "grf23_nodes": _nodes,
    "top7_condensed": lambda s, d: W.condensed_order(*_flow(s, d)),
    "top7_compiled": lambda s, d: W.compiled_order(*_flow(s, d)),
    "grf9_workflow_terminals": lambda s, d: W.workflow_terminals(*_flow(s, d)),
}
_ID = "coalesce(nullif(trim(regexp_replace(trim(regexp_extract({}, '[^#/]*$')), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'workflow')".format
_G = f"""WITH RECURSIVE e AS ({FLOW_SQL}), n AS (SELECT workflow, src node FROM e UNION SELECT workflow, dst FROM e), c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src),
 k AS (SELECT node, least(node, (SELECT min(x.b) FROM c x JOIN c y ON x.b = y.a AND y.b = x.a WHERE x.a = node)) component FROM n), g AS (SELECT DISTINCT s.component a, t.component b FROM e JOIN k s ON src = s.node JOIN k t ON dst = t.node WHERE s.component <> t.component),
 v(component, level) AS (SELECT DISTINCT component, 0 FROM k UNION SELECT b, level + 1 FROM v JOIN g ON a = component), o AS (SELECT node, component, CAST(max(level) AS INTEGER) level FROM k JOIN v USING (component) GROUP BY 1, 2)"""
ORACLE_SQL = {
    "grf23_nodes": f"""WITH t AS (SELECT DISTINCT * FROM ({TRIPLES_SQL})), v AS (SELECT s, p, min(o) o FROM t GROUP BY s, p),
 k AS (SELECT s, list_max(list(CASE o WHEN 'Phase' THEN 1 WHEN 'Step' THEN 2 WHEN 'Decision' THEN 3 WHEN 'Validation' THEN 4 WHEN 'Group' THEN 5 END)) r FROM t WHERE p = 'type' AND o IN ('Phase', 'Step', 'Decision', 'Validation', 'Group') GROUP BY s),
 n AS (SELECT s AS uri, {_ID("s")} id, ['phase', 'step', 'decision', 'validation', 'group'][r] AS type, {", ".join(f"(SELECT o FROM v WHERE v.s = k.s AND p = '{c}') {c}_" for c in ("label", "status", "instruction", "judge", "harness"))} FROM k),
 b AS (SELECT s, string_agg(concat_ws('>', c, g, l), ';' ORDER BY c, g, l) branches FROM (SELECT DISTINCT h.s, h.o, w.o c, coalesce((SELECT {_ID("o")} FROM v WHERE v.s = h.o AND p = 'goto'), '') g, coalesce((SELECT o FROM v WHERE v.s = h.o AND p = 'label'), w.o) l
  FROM t h JOIN v w ON w.s = h.o AND w.p = 'on' AND w.o <> '' WHERE h.p = 'hasBranch') h GROUP BY s),
 ph AS (SELECT o AS s, max({_ID("s")}) phase_id FROM t WHERE p = 'hasNode' GROUP BY o), pc AS (SELECT s, string_agg(o, ';' ORDER BY o) c FROM t WHERE p = 'passCriteria' GROUP BY s)
 SELECT uri, id, type, coalesce(nullif(label_, ''), id) AS label, status_ status, CASE WHEN type <> 'phase' THEN instruction_ END instruction, judge_ judge, harness_ harness, coalesce(c, '') pass_criteria,
  CASE WHEN type = 'decision' THEN CASE judge_ WHEN 'model' THEN 'cloud' WHEN 'human' THEN 'desk' ELSE 'local-ollama' END ELSE CASE type WHEN 'phase' THEN 'planner' WHEN 'step' THEN 'runner' WHEN 'validation' THEN 'checker' ELSE 'local-ollama' END END provider,
  phase_id, coalesce(branches, '') branches FROM n LEFT JOIN b ON b.s = uri LEFT JOIN ph ON ph.s = uri LEFT JOIN pc ON pc.s = uri""",
    "top7_condensed": _G + " SELECT * FROM o",
    "top7_compiled": _G + " SELECT workflow, node, bool_or(many) OVER (PARTITION BY workflow) cyclic, CASE WHEN bool_or(many) OVER (PARTITION BY workflow) THEN 0 ELSE level END AS level FROM (SELECT workflow, node, level, count(*) OVER (PARTITION BY component) > 1 many FROM n JOIN o USING (node))",
    "grf9_workflow_terminals": f"""WITH e AS ({FLOW_SQL}), n AS (SELECT workflow, src node FROM e UNION SELECT workflow, dst FROM e), i AS (SELECT * FROM n WHERE node NOT IN (SELECT dst FROM e))
 SELECT workflow, node, 'entry' AS role, false forced FROM i UNION ALL SELECT workflow, min(node), 'entry', true FROM n WHERE workflow NOT IN (SELECT workflow FROM i) GROUP BY workflow UNION ALL SELECT workflow, node, 'exit', false FROM n WHERE node NOT IN (SELECT src FROM e)""",
}
