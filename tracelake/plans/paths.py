"""Path rules over the shared tables: orders are nodes of six classes, line items the branches of evaluations and decisions."""

from __future__ import annotations

from ..operators import paths as P
from ..schemas import read

_N = "CASE WHEN o_orderkey % 6 = 3 THEN 'n/' || o_orderkey || '/step-' || (o_custkey % 20) ELSE 'n/' || o_orderkey END"
_TOOL = "CASE WHEN o_custkey % 2 = 0 THEN '[[tool ' || (o_custkey % 9) || ']]' ELSE 'Tool:' || (o_custkey % 9) END"
_A = "'a/' || (o_custkey % 300)"
#: SQL that Spark and DuckDB both run. Every rule is broken by some nodes and kept by others.
TRIPLES_SQL = f"""WITH o AS (SELECT *, {_N} AS node, o_orderkey % 6 AS c, {_A} AS art, {_TOOL} AS tool FROM orders), l AS (SELECT *, 'b/' || l_orderkey || '-' || l_linenumber AS b FROM lineitem WHERE l_orderkey % 6 IN (0, 2))
 SELECT node AS s, 'type' AS p, CASE c WHEN 0 THEN 'Eval' WHEN 1 THEN 'Task' WHEN 2 THEN 'Decision' WHEN 3 THEN 'Step' WHEN 4 THEN 'Group' ELSE CASE WHEN o_orderkey % 12 = 5 THEN 'Start' ELSE 'End' END END AS o FROM o
 UNION ALL SELECT 'wf/' || (o_custkey % 40), 'type', 'Workflow' FROM o WHERE o_custkey % 40 < 37 UNION ALL SELECT 'wf/' || (o_custkey % 40), 'hasNode', node FROM o
 UNION ALL SELECT node, 'target', 'wf/' || CASE WHEN o_custkey % 8 = 0 THEN o_custkey % 40 ELSE o_custkey * 3 % 40 END FROM o WHERE c = 0 AND o_orderkey % 7 <> 0
 UNION ALL SELECT node, 'targetArtifact', CASE o_custkey % 4 WHEN 2 THEN 'memo-' || (o_custkey % 50) WHEN 3 THEN 'data/x' || (o_custkey % 30) ELSE tool END FROM o WHERE c = 0 AND o_orderkey % 11 <> 0
 UNION ALL SELECT node, 'usesTool', tool FROM o WHERE c = 3 AND o_custkey % 9 <> 4 UNION ALL SELECT node, 'targetArtifact', tool FROM o WHERE c = 3 AND o_orderkey % 4 <> 1
 UNION ALL SELECT node, 'orderTarget', 'step-' || (o_custkey % 23) FROM o WHERE c = 0 AND o_custkey % 3 <> 0 UNION ALL SELECT node, 'evolves', 'wf/' || (o_custkey % 40) FROM o WHERE c = 1
 UNION ALL SELECT node, 'next', 'n/' || (o_orderkey + 1) FROM o WHERE c < 3 AND o_orderkey % 8 = 2 UNION ALL SELECT 'n/' || l_orderkey, 'hasBranch', b FROM l WHERE l_linenumber < 6
 UNION ALL SELECT b, 'on', CASE l_linenumber WHEN 1 THEN 'fail' WHEN 2 THEN 'Pass' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'passed' ELSE 'other' END FROM l
 UNION ALL SELECT b, 'gotoNode', CASE WHEN l_orderkey % 6 = 2 THEN 'n/' || (l_orderkey + 1 + l_partkey % 2) ELSE 'n/' || (6 * (l_partkey % 2000) + 1) END FROM l WHERE l_partkey % 3 <> 0
 UNION ALL SELECT node, 'produces', art FROM o WHERE c IN (1, 2, 3) AND o_custkey % 7 < 4 UNION ALL SELECT art, 'type', 'Artifact' FROM o WHERE o_custkey % 300 % 5 <> 0 UNION ALL SELECT art, 'label', 'memo-' || (o_custkey % 300 % 50) FROM o
 UNION ALL SELECT art, 'measures', node FROM o WHERE c = 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT art, 'measures', node FROM o WHERE c = 1 AND o_custkey % 90 = 1
 UNION ALL SELECT art, CASE WHEN o_custkey % 4 = 0 THEN 'consumes' ELSE 'check' END, node FROM o WHERE c = 3 AND o_custkey % 4 < 2 OR c = 0 AND o_custkey % 50 < 3
 UNION ALL SELECT node, 'deliverables', 'memo-' || (o_custkey % 50) FROM o WHERE c IN (1, 3) AND o_custkey % 6 = 0 UNION ALL SELECT node, 'directory', 'd/' || o_orderkey FROM o WHERE c IN (1, 3) AND o_custkey % 5 = 0
 UNION ALL SELECT 'd/' || o_orderkey, 'dirPath', 'data/x' || (o_custkey % 30) FROM o WHERE c IN (1, 3)
 UNION ALL SELECT 'd/' || o_orderkey, 'dirRole', CASE o_custkey % 7 WHEN 1 THEN 'Output-log' WHEN 2 THEN 'staging' WHEN 3 THEN 'read' WHEN 4 THEN 'style input' WHEN 5 THEN 'write' ELSE 'scratch' END FROM o WHERE c IN (1, 3) AND o_custkey % 7 > 0
 UNION ALL SELECT art, 'produces', 'x' FROM o WHERE o_custkey % 97 = 0 UNION ALL SELECT 's/' || o_orderkey, 'type', 'Stream' FROM o WHERE c = 5
 UNION ALL SELECT 's/' || o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'from' ELSE 'to' END, CASE WHEN o_orderkey % 9 < 5 THEN node ELSE art END FROM o WHERE c = 5"""


def triples(spark, d):
    sql = TRIPLES_SQL.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(sql, orders=read(spark, d, "orders"), lineitem=read(spark, d, "lineitem"))


QUERIES = {"con9_path_rules": lambda s, d: P.violations(triples(s, d))}

_IS = "SELECT s FROM t WHERE p = 'type' AND o IN ({})".format
_OUT = "(SELECT d.s, x.o AS path FROM t d JOIN t x ON d.o = x.s JOIN t r ON d.o = r.s WHERE d.p = 'directory' AND x.p = 'dirPath' AND r.p = 'dirRole' AND (contains(lower(r.o), 'output') OR lower(r.o) IN ('staging', 'generated', 'write')))"
_IN = """(SELECT d.s FROM t d JOIN t x ON d.o = x.s LEFT JOIN (SELECT s, lower(o) r FROM t WHERE p = 'dirRole') r ON d.o = r.s WHERE d.p = 'directory' AND x.p = 'dirPath' AND (r IS NULL OR regexp_matches(r, 'input|reference|instruction') OR r IN ('staging', 'read')))"""
_TOOLS = "(o LIKE '[[%' OR lower(o) LIKE 'tool:%' OR lower(o) LIKE 'process:%')"
_GIVES = f"(SELECT s FROM t WHERE p = 'deliverables' UNION SELECT s FROM {_OUT})"
ORACLE_SQL = {
    "con9_path_rules": f"""WITH t AS (SELECT DISTINCT * FROM ({TRIPLES_SQL})), e AS ({_IS("'Eval'")}), w AS ({_IS("'Workflow'")}), a AS ({_IS("'Artifact'")}), td AS ({_IS("'Task', 'Decision'")}),
 tg AS (SELECT s, o FROM t WHERE p = 'target' AND s IN (FROM e)), la AS (SELECT s, o FROM t WHERE p = 'targetArtifact' AND s IN (FROM e)), br AS (SELECT h.s, h.o AS b, lower(c.o) k, g.o AS goto FROM t h LEFT JOIN t c ON c.s = h.o AND c.p = 'on' LEFT JOIN t g ON g.s = h.o AND g.p = 'gotoNode' WHERE h.p = 'hasBranch'),
 mk AS (SELECT h.s AS wf, h.o AS n FROM t h WHERE h.p = 'hasNode' AND h.o IN (FROM td)), pr AS (SELECT wf, n, o AS art FROM mk JOIN t ON t.s = n AND p = 'produces'),
 lb AS (SELECT wf, o AS l FROM mk JOIN t ON t.s = n AND p = 'deliverables' UNION SELECT wf, o FROM pr JOIN t ON t.s = art AND p = 'label' WHERE art IN (FROM a) UNION SELECT wf, path FROM mk JOIN {_OUT} f ON f.s = n),
 us AS (SELECT s, o FROM t WHERE p = 'usesTool' AND s IN ({_IS("'Step'")})), ev AS (SELECT br.s, v.o FROM br JOIN t v ON v.s = br.goto AND v.p = 'evolves' WHERE k IN ('fail', 'failed') AND goto IN ({_IS("'Task'")}) AND v.o IN (FROM w)),
 two AS (SELECT s FROM br GROUP BY s HAVING count(DISTINCT b) > 1)
 SELECT DISTINCT rule, s AS focus FROM (
 SELECT 'eval-artifact' AS rule, s FROM e WHERE s NOT IN (SELECT s FROM la) UNION ALL SELECT 'eval-target', s FROM e WHERE s NOT IN (SELECT s FROM tg) UNION ALL SELECT 'eval-target-class', s FROM tg WHERE o NOT IN (FROM w)
 UNION ALL SELECT 'eval-own-container', tg.s FROM tg JOIN t ON t.p = 'hasNode' AND t.s = tg.o AND t.o = tg.s UNION ALL SELECT 'evolves-class', s FROM t WHERE p = 'evolves' AND o NOT IN (FROM w)
 UNION ALL SELECT 'eval-fail-evolves', s FROM (SELECT s, o FROM tg EXCEPT SELECT s, o FROM ev) UNION ALL SELECT 'eval-pass-terminal', s FROM e WHERE s NOT IN (SELECT s FROM br WHERE k IN ('pass', 'passed') AND goto IS NULL)
 UNION ALL SELECT 'eval-next', s FROM t WHERE p = 'next' AND s IN (FROM e) UNION ALL SELECT 'eval-consumes', o FROM t WHERE p IN ('consumes', 'check') AND o IN (FROM e)
 UNION ALL SELECT 'eval-evidence-producer', s FROM (SELECT tg.s, tg.o AS wf, m.s AS art FROM tg JOIN t m ON m.p = 'measures' AND m.o = tg.s) x WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.wf = x.wf AND pr.art = x.art)
 UNION ALL SELECT 'eval-label-producer', s FROM (SELECT tg.s, tg.o AS wf, la.o FROM tg JOIN la ON la.s = tg.s) x WHERE NOT {_TOOLS} AND NOT EXISTS (SELECT 1 FROM lb WHERE lb.wf = x.wf AND lb.l = x.o)
 UNION ALL SELECT 'eval-branches', s FROM e WHERE s NOT IN (FROM two) UNION ALL SELECT 'decision-branches', s FROM ({_IS("'Decision'")}) WHERE s NOT IN (FROM two)
 UNION ALL SELECT 'decision-redundant-next', t.s FROM t JOIN br ON br.s = t.s AND br.goto = t.o WHERE p = 'next' AND t.s IN ({_IS("'Decision'")})
 UNION ALL SELECT 'tool-input', s FROM us WHERE s NOT IN {_IN} AND s NOT IN (SELECT o FROM t WHERE p IN ('consumes', 'check') AND s IN (FROM a))
 UNION ALL SELECT 'tool-output', s FROM us WHERE s NOT IN {_GIVES} AND s NOT IN (SELECT s FROM t WHERE p = 'produces' AND o IN (FROM a))
 UNION ALL SELECT 'eval-tool-producer', s FROM la WHERE {_TOOLS} AND o NOT IN (SELECT o FROM us WHERE s IN {_GIVES})
 UNION ALL SELECT 'eval-revision', s FROM (SELECT la.s, la.o, r.o AS step FROM la JOIN t r ON r.p = 'orderTarget' AND r.s = la.s) x WHERE {_TOOLS} AND NOT EXISTS (SELECT 1 FROM t y WHERE y.p = 'targetArtifact' AND y.o = x.o AND y.s IN ({_IS("'Step'")}) AND regexp_replace(y.s, '^.*/', '') = x.step)
 UNION ALL SELECT 'artifact-produces', s FROM t WHERE p = 'produces' AND s IN (FROM a) UNION ALL SELECT 'artifact-measures', s FROM t WHERE p = 'measures' AND s IN (FROM a) AND o NOT IN (FROM e)
 UNION ALL SELECT 'artifact-consumed-by-eval', s FROM t WHERE p IN ('consumes', 'check') AND s IN (FROM a) AND o IN (FROM e)
 UNION ALL SELECT 'stream-terminal', s FROM t WHERE p IN ('from', 'to') AND s IN ({_IS("'Stream'")}) AND o IN ({_IS("'Start', 'End'")}))""",
}
