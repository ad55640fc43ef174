"""Documents, edge models, trees, drift and locators over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl as E
from ..operators import graph as G
from ..operators import rules as R
from ..operators import views as V
from ..schemas import CONTROL_SQL, control, read

#: SQL that Spark and DuckDB both run: every line item is an edge of a kind by its number; a node's class goes by its number.
EDGES_SQL = """SELECT 'e' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge, CASE WHEN l_linenumber IN (5, 6) THEN 'Stream' ELSE 'Rail' END AS class, 'n/' || (l_orderkey % 1000) AS src, 'n/' || (l_partkey % 1000) AS dst,
  CASE l_linenumber WHEN 3 THEN 'measured_by' WHEN 4 THEN 'measures' WHEN 5 THEN 'consumed_by' WHEN 6 THEN 'produces_to' WHEN 7 THEN 'evolves_to' ELSE 'default' END AS kind,
  CASE WHEN l_linenumber = 2 THEN CASE l_returnflag WHEN 'A' THEN 'pass' ELSE 'fail' END END AS on_case, CASE WHEN l_linenumber = 2 AND l_quantity > 25 THEN 'c' END AS criteria FROM lineitem"""
CLASSES_SQL = """SELECT 'n/' || k AS node, CASE k % 10 WHEN 0 THEN 'Start' WHEN 1 THEN 'End' WHEN 2 THEN 'Artifact' WHEN 3 THEN 'Eval' WHEN 4 THEN 'Decision' ELSE 'Task' END AS class,
  CASE k % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'system' ELSE 'self' END AS subject, CASE k % 4 WHEN 0 THEN 'trust' WHEN 1 THEN 'charm' END AS dimension, 'w' || (k % 7) AS workflow
  FROM (SELECT DISTINCT l_partkey % 1000 AS k FROM lineitem UNION SELECT DISTINCT l_orderkey % 1000 FROM lineitem)"""


def _sql(spark, d, sql):
    return spark.sql(sql.replace("FROM lineitem", "FROM {li}"), li=read(spark, d, "lineitem"))


def edges(spark, d):
    return _sql(spark, d, EDGES_SQL).withColumnRenamed("on_case", "on")


def classes(spark, d):
    return _sql(spark, d, CLASSES_SQL)


def documents(spark, d):
    """Each conversation as the JSON of one workflow; assistants' turns branch, the last of them to nowhere, others have a directory."""
    c = read(spark, d, "conversations")
    bot = F.col("role") == "assistant"
    node = F.struct(
        F.concat(F.lit("t"), "turn").alias("id"), F.col("role").alias("type"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Turn "), "turn")).alias("label"),
        F.when(bot, F.array(F.struct(F.lit("ok").alias("on"), F.when(F.col("turn") < 5, F.concat(F.lit("t"), F.col("turn") + 1)).alias("goto")))).alias("branches"),
        F.when(~bot, F.array(F.struct(F.lit("data/").alias("path"), F.lit("input").alias("role")))).alias("directories"),
    )
    w = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    doc = F.struct(F.lit("p").alias("project"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("m"), "conv_id")).alias("module"), F.array(F.struct(F.concat(F.lit("w"), "conv_id").alias("id"), "nodes")).alias("workflows"))
    return w.select(F.to_json(doc).alias("value"))


def _rails(spark, d):
    """Rails, streams, membership and artifacts of the edges."""
    e, c = edges(spark, d), classes(spark, d)
    of = lambda kind: e.where(F.col("class") == kind).select("src", "kind", "dst")
    return of("Rail"), of("Stream"), c.select("workflow", "node"), c.where("class = 'Artifact'").select(F.col("node").alias("id"))


def _folders(spark, d):
    """Parts register folders, many of them the same, with and without a last slash."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    source = F.when(k % 3 == 0, "subdir").when(k % 3 == 1, "module").otherwise("data_registry")
    where = F.concat(F.lit("m"), F.col("p_size"), F.when(k % 5 > 1, F.concat(F.lit("/d"), k % 7)).otherwise(""), F.when(k % 2 == 0, "/").otherwise(""))
    return p.select(F.concat(F.lit("p"), k).alias("id"), F.lit("local_file").alias("data_type"), where.alias("locator"), source.alias("source"), (k % 11).alias("place"))


def _judges(spark, d):
    code = F.get(F.array(*map(F.lit, ("HITL", "hitlfe", " HOTL", "hootl ", "Metric", "model", ""))), (F.col("o_custkey") % 8).cast("int"))
    return read(spark, d, "orders").select(code.alias("judge")).groupBy("judge").agg(F.count("*").alias("n"))


def _control(spark, d):
    rails, _, members, artifacts = _rails(spark, d)
    return V.view_counts(V.control_view(rails, members, artifacts))


def _combined(spark, d):
    rails, streams, members, _ = _rails(spark, d)
    return V.view_counts(V.combined_view(rails, streams, members), members)


def _older(spark, d):
    """The edges in the older model: no starts, ends or artifacts, so that nothing is left out."""
    plain = classes(spark, d).select("node", F.lit("Task").alias("class"), "subject")
    return E.downgrade(edges(spark, d), plain)


def _tree(spark, d):
    """An order's customer refers to that of the next order; nations are the roots; some customers are not there."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    refs = o.select((F.col("o_custkey") % 300).alias("doc"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 320).alias("sub")).distinct()
    known = c.select(F.col("c_custkey").alias("doc")).where("doc < 310").unionByName(c.select((F.col("c_custkey") * 0).alias("doc")).distinct())
    return E.resolve_tree(read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc")), refs, known)


def _drift(spark, d):
    """Extra parts have keys of their own, whatever numbers the parts have: those with an offset are told by it."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size", F.lit(0).alias("offset"))
    extra = p.where("p_size = 3").withColumn("offset", F.lit(1_000_000))
    now = p.where("p_size <> 7").withColumn("p_size", F.when(F.col("p_size") == 9, 10).otherwise(F.col("p_size"))).unionByName(extra)
    return E.drift(p, now, key=["p_partkey", "offset"]).select((F.col("p_partkey") + F.col("offset")).alias("p_partkey"), "state")


def _locators(spark, d):
    s, p = read(spark, d, "supplier"), read(spark, d, "part")
    registry = s.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.concat(F.lit("root/m"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/d"), F.col("s_suppkey") % 5)).otherwise(F.lit("")), F.lit("/")).alias("locator"))
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("./root/m"), k % 25)).when(k % 4 == 1, F.concat(F.lit("root//m"), k % 25, F.lit("/d"), k % 5, F.lit("/x/y"), k % 9)).when(k % 4 == 2, F.concat(F.lit("d"), k % 9, F.lit("/"))).otherwise(F.concat(F.lit("other"), k % 7))
    return E.resolve_locators(p.select(path.alias("locator"), F.when(k % 5 == 0, "table").otherwise("local_file").alias("data_type")), registry)


def _schema(spark):
    rows = [("Task", "name", True, "string", None, None, None), ("Task", "size", True, "integer", None, None, None), ("Task", "mode", None, "enum", ["a", "b"], None, None), ("Task", "note", None, "string", None, "mode", ["b"])]
    return spark.createDataFrame(rows, "class string, field string, required boolean, kind string, allowed array<string>, when_field string, when_values array<string>")


def _fields(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_size")
    v = p.select(F.col("p_partkey").alias("node"), F.explode(F.array(
        F.struct(F.lit("name").alias("field"), F.when(k % 11 != 0, F.col("p_name")).alias("value")), F.struct(F.lit("size").alias("field"), F.when(k % 7 == 0, F.lit("x")).otherwise(k.cast("string")).alias("value")),
        F.struct(F.lit("mode").alias("field"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("c").alias("value")), F.struct(F.lit("note").alias("field"), F.when(k % 2 == 0, F.lit("n")).alias("value")),
    )).alias("x")).select("node", "x.*")
    return R.fields(p.select(F.col("p_partkey").alias("node"), F.lit("Task").alias("class")), v, _schema(spark))


def _evaluation(spark, d):
    n = classes(spark, d)
    w = n.select("workflow").distinct().withColumn("type", F.when(F.col("workflow").isin("w1", "w2", "w3"), "oracle").otherwise("base"))
    return R.evaluation(n, edges(spark, d), n.select("workflow", "node"), w)


def _index(spark, d):
    """Each supplier as an index document of one registered item and one module."""
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    item = F.struct(F.concat(F.lit("d"), k).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("./x//"), k)).alias("location"), F.when(k % 3 != 0, F.concat(F.lit("y/"), k)).alias("path"), F.when(k % 5 == 0, "table").alias("type"))
    subs = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("data/in/").alias("path")), F.struct(F.concat(F.lit("o"), k).alias("id"), F.lit("out").alias("path")))
    module = F.struct(F.concat(F.lit("m"), k).alias("id"), F.concat(F.lit("m"), k, F.lit("/")).alias("path"), F.when(k % 4 == 0, "planned").when(k % 4 == 1, "Active").alias("status"), subs.alias("subdirs"))
    return s.select(F.to_json(F.struct(F.array(item).alias("data_registry"), F.array(module).alias("modules"))).alias("value"))


def _uses(spark, d):
    """Suppliers use the parts that they ship, in the scope of their nation; a sixth of the parts are deliverables, some are tables."""
    li, s = read(spark, d, "lineitem"), read(spark, d, "supplier")
    met = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select(F.col("s_suppkey").alias("unit"), F.concat(F.when(F.col("l_partkey") % 6 == 0, "deliverable:").otherwise(""), F.col("l_partkey")).alias("artifact"), F.col("s_nationkey").alias("scope"), F.when(F.col("l_partkey") % 7 == 0, "table").otherwise("document").alias("type"), (F.col("l_linenumber") == 1).alias("produces"), (F.col("l_linenumber") > 1).alias("consumes"))


def _uncontrolled(spark, d):
    return G.uncontrolled(control(spark, d), read(spark, d, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("node")))


def _improvements(spark, d):
    """Nodes live in workflows of the edge model, which evolve and test each other's artifacts; three workflows stand under another."""
    n = classes(spark, d)
    e = edges(spark, d)
    to_flows = e.where("kind = 'measures'").select("edge", "class", "src", F.concat(F.lit("w"), F.substring("dst", -1, 1)).alias("dst"), F.lit("tests_to").alias("kind"), "on", "criteria")
    subs = n.where("workflow IN ('w1', 'w2', 'w3')").select(F.concat(F.lit("w"), F.substring("workflow", 2, 1).cast("int") + 1).alias("src"), F.col("workflow").alias("dst")).distinct()
    return G.improvement_issues(e.unionByName(to_flows), n.select("workflow", "node"), n.where("class = 'Artifact'").select("node"), subs)


def _ranges(spark, d):
    t = _older(spark, d).where("p IN ('next', 'consumes')")
    rules = spark.createDataFrame([("next", "Task"), ("consumes", "Artifact")], "p string, class string")
    return R.range_classes(t, classes(spark, d), rules)


QUERIES = {
    "grf13_improvements": _improvements,
    "con5_ranges": _ranges,
    "src7_registry": lambda s, d: E.registry_rows(_index(s, d)).select("id", "data_type", "locator", "source"),
    "agg17_shared": lambda s, d: G.shared_artifacts(_uses(s, d)),
    "grf14_uncontrolled": _uncontrolled,
    "etl1_nodes": lambda s, d: E.flatten(documents(s, d))[0],
    "etl1_edges": lambda s, d: E.flatten(documents(s, d))[1],
    "etl1_directories": lambda s, d: E.flatten(documents(s, d))[2],
    "etl3_upgrade": lambda s, d: E.upgrade(_older(s, d).where("p <> 'type' OR o = 'Task'"))[0].select("class", "src", "dst", "kind", "on", "criteria"),
    "etl4_downgrade": lambda s, d: E.downgrade(edges(s, d), classes(s, d)).where("p NOT IN ('hasBranch') AND s NOT LIKE 'branch/%'"),
    "etl4_branches": lambda s, d: E.downgrade(edges(s, d), classes(s, d)).where("s LIKE 'branch/%'").groupBy("p", "o").agg(F.count("*").alias("n")),
    "etl5_documents": lambda s, d: _tree(s, d)[0].withColumn("depth", F.col("depth").cast("int")),
    "etl5_issues": lambda s, d: _tree(s, d)[1],
    "grf8_control_view": _control,
    "src7_lookup": lambda s, d: E.registry_lookup(_folders(s, d), "place"),
    "fn13_layers": lambda s, d: edges(s, d).groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", G.rail_layer(F.col("kind")).alias("layer"), G.is_hand_off(F.col("kind")).alias("hand_off")),
    "fn14_judges": lambda s, d: _judges(s, d).select("judge", "n", G.judge_subject(F.col("judge")).alias("subject")),
    "grf8_combined_view": _combined,
    "etl6_drift": _drift,
    "join6_locators": _locators,
    "con8_evaluation": _evaluation,
    "con14_fields": _fields,
}

_C = f"WITH e AS ({EDGES_SQL}), k AS ({CLASSES_SQL})"
_D = """WITH c AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'm' || conv_id ELSE 'w' || conv_id END scope FROM conversations)"""
_TREE = """WITH RECURSIVE refs AS (SELECT DISTINCT o_custkey % 300 doc, (o_custkey * 7 + o_orderkey) % 320 sub FROM orders),
 known AS (SELECT c_custkey doc FROM customer WHERE c_custkey < 310 UNION SELECT 0),
 walk(root, doc, depth) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation UNION SELECT root, sub, depth + 1 FROM walk JOIN refs USING (doc) WHERE depth < 3 AND sub IN (SELECT doc FROM known)),
 docs AS (SELECT root, doc, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2)"""
ORACLE_SQL = {
    "grf13_improvements": _C + """, x AS (SELECT src, dst, kind FROM e UNION ALL SELECT src, 'w' || right(dst, 1), 'tests_to' FROM e WHERE kind = 'measures'),
  m AS (SELECT DISTINCT x.src node, kind, dst target, k.workflow FROM x JOIN k ON src = k.node WHERE kind IN ('evolves_to', 'tests_to')), a AS (SELECT node FROM k WHERE class = 'Artifact'),
  kin AS (SELECT 'w' || g.i w, 'w' || h.i t FROM range(1, 5) g(i), range(1, 5) h(i))
  SELECT *, 'self-produced' issue FROM m WHERE target IN (FROM a) AND EXISTS (SELECT 1 FROM e JOIN k ON e.src = k.node WHERE e.kind = 'produces_to' AND e.dst = m.target AND k.workflow = m.workflow)
  UNION ALL SELECT *, 'unconsumed' FROM m WHERE target IN (FROM a) AND target NOT IN (SELECT src FROM e WHERE kind = 'consumed_by')
  UNION ALL SELECT *, 'not disjoint' FROM m WHERE target NOT IN (FROM a) AND (workflow = target OR (workflow, target) IN (FROM kin))""",
    "con5_ranges": _C + """ SELECT DISTINCT src s, 'next' p, dst o FROM e JOIN k ON dst = node WHERE kind = 'default' AND on_case IS NULL AND k.class <> 'Task' UNION ALL SELECT DISTINCT src, 'consumes', dst FROM e JOIN k ON dst = node WHERE kind = 'consumed_by' AND k.class <> 'Artifact'""",
    "src7_registry": """SELECT 'd' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'table' ELSE 'local_file' END data_type, CASE WHEN s_suppkey % 2 = 0 THEN 'x/' || s_suppkey ELSE 'y/' || s_suppkey END locator, 'data_registry' AS source FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0
  UNION ALL SELECT 'm' || s_suppkey, 'local_file', 'm' || s_suppkey || '/', 'module' FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'm' || s_suppkey || '.data.in', 'local_file', 'm' || s_suppkey || '/data/in/', 'subdir' FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT 'o' || s_suppkey, 'local_file', 'm' || s_suppkey || '/out', 'subdir' FROM supplier WHERE s_suppkey % 4 <> 0""",
    "agg17_shared": """WITH u AS (SELECT l_suppkey AS unit, CAST(l_partkey AS VARCHAR) artifact, s_nationkey AS scope, l_partkey % 7 = 0 nat, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 6 <> 0),
  w AS (SELECT artifact FROM u GROUP BY 1 HAVING count(DISTINCT scope) > 1 OR bool_or(nat)) SELECT unit, artifact, bool_or(l_linenumber = 1) produces, bool_or(l_linenumber > 1) consumes FROM u JOIN w USING (artifact) GROUP BY 1, 2""",
    "grf14_uncontrolled": f"""WITH RECURSIVE e AS (SELECT * FROM ({CONTROL_SQL}) WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) AND dst NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)),
  c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT a.src node, min(a.dst) component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""",
    "etl1_nodes": _D + " SELECT 'node/' || scope || '/t' || turn AS id, role AS type, CASE WHEN turn % 2 = 0 THEN 'Turn ' || turn ELSE 't' || turn END AS label, 'workflow/' || scope || '/w' || conv_id workflow FROM c",
    "etl1_edges": _D + """ SELECT 'node/' || scope || '/t' || turn src, CASE WHEN turn < 5 THEN 'node/' || scope || '/t' || (turn + 1) END dst, 'ok' AS "on" FROM c WHERE role = 'assistant'
  UNION ALL SELECT src, dst, NULL FROM (SELECT role, 'node/' || scope || '/t' || turn src, 'node/' || scope || '/t' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) dst FROM c) WHERE dst IS NOT NULL AND role <> 'assistant'""",
    "etl1_directories": _D + " SELECT 'node/' || scope || '/t' || turn node, 'data/' AS path, 'input' AS role FROM c WHERE role <> 'assistant'",
    "etl3_upgrade": _C + """ SELECT DISTINCT class, src, dst, kind, on_case AS "on", criteria FROM e""",
    "etl4_downgrade": _C + """, x AS (SELECT e.*, a.class a, b.class b FROM e JOIN k a ON src = a.node JOIN k b ON dst = b.node)
  SELECT DISTINCT src s, 'next' p, dst o FROM x WHERE kind = 'default' AND on_case IS NULL AND a <> 'Start' AND b <> 'End' UNION ALL SELECT DISTINCT src, 'consumes', dst FROM x WHERE kind = 'consumed_by' UNION ALL SELECT DISTINCT src, 'produces', dst FROM x WHERE kind = 'produces_to'
  UNION ALL SELECT DISTINCT src, 'measures', dst FROM x WHERE kind = 'measured_by' UNION ALL SELECT DISTINCT src, 'target', dst FROM x WHERE kind = 'measures' UNION ALL SELECT DISTINCT src, 'evolves', dst FROM x WHERE kind = 'evolves_to' AND b <> 'Artifact'
  UNION ALL SELECT node, 'type', unnest(CASE WHEN class IN ('Eval', 'Decision') THEN ['Node'] ELSE ['Node', 'Step', 'Task'] END) FROM k WHERE class NOT IN ('Start', 'End', 'Artifact')
  UNION ALL SELECT node, CASE class WHEN 'Eval' THEN 'oracleType' ELSE 'decisionSubject' END, CASE WHEN subject = 'human' THEN 'user' WHEN subject = 'system' AND class = 'Eval' THEN 'metric' ELSE 'agent' END FROM k WHERE class IN ('Eval', 'Decision')""",
    "etl4_branches": _C + """, x AS (SELECT e.*, b.class b FROM e JOIN k a ON src = a.node JOIN k b ON dst = b.node WHERE kind = 'default' AND on_case IS NOT NULL AND a.class <> 'Start')
  SELECT p, o, count(*) n FROM (SELECT 'type' p, 'Branch' o FROM x UNION ALL SELECT 'on', on_case FROM x UNION ALL SELECT 'criteria', criteria FROM x WHERE criteria IS NOT NULL UNION ALL SELECT 'gotoNode', dst FROM x WHERE b <> 'End' UNION ALL SELECT 'goto', split_part(dst, '/', 2) FROM x WHERE b <> 'End') GROUP BY 1, 2""",
    "etl5_documents": _TREE + " SELECT * FROM docs",
    "src7_lookup": """WITH p AS (SELECT 'p' || p_partkey id, 'm' || p_size || CASE WHEN p_partkey % 5 > 1 THEN '/d' || (p_partkey % 7) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END locator, p_partkey % 3 k, p_partkey % 11 place FROM part),
 x AS (SELECT *, locator AS key FROM p UNION SELECT *, CASE WHEN locator LIKE '%/' THEN rtrim(locator, '/') ELSE locator || '/' END FROM p)
 SELECT key, id, 'local_file' data_type, locator, ['subdir', 'module', 'data_registry'][k + 1] AS source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY -k, place, id) n FROM x) WHERE n = 1""",
    "fn13_layers": f"SELECT kind, count(*) n, CASE WHEN kind IN ('measured_by', 'measures', 'evolves_to') THEN 'oracle' WHEN kind = 'default' THEN 'base' ELSE 'unknown' END AS layer, false hand_off FROM ({EDGES_SQL}) GROUP BY kind",
    "fn14_judges": """SELECT judge, n, CASE upper(trim(judge)) WHEN 'HITL' THEN 'human' WHEN 'HITLFE' THEN 'human' WHEN 'HOTL' THEN 'self' WHEN 'HOOTL' THEN 'self' WHEN 'METRIC' THEN 'system' END subject
  FROM (SELECT ['HITL', 'hitlfe', ' HOTL', 'hootl ', 'Metric', 'model', ''][o_custkey % 8 + 1] judge, count(*) n FROM orders GROUP BY 1)""",
    "grf8_control_view": f"""WITH e AS ({EDGES_SQL}), c AS ({CLASSES_SQL}), v AS (SELECT DISTINCT workflow, src, kind, dst FROM e JOIN c ON src = node OR dst = node WHERE e.class = 'Rail'
  AND src NOT IN (SELECT node FROM c WHERE class = 'Artifact') AND dst NOT IN (SELECT node FROM c WHERE class = 'Artifact')), x AS (SELECT workflow, src AS node FROM v UNION SELECT workflow, dst FROM v)
  SELECT workflow, count(*) nodes, (SELECT count(*) FROM v WHERE v.workflow = x.workflow) edges FROM x GROUP BY workflow""",
    "grf8_combined_view": f"""WITH e AS ({EDGES_SQL}), c AS ({CLASSES_SQL}), r AS (SELECT DISTINCT workflow, src, kind, dst FROM e JOIN c ON src = node OR dst = node WHERE e.class = 'Rail'),
 t AS (SELECT DISTINCT workflow, src, dst FROM e JOIN c ON src = node OR dst = node WHERE e.class = 'Stream'), k AS (SELECT workflow, node FROM c UNION SELECT workflow, src FROM t UNION SELECT workflow, dst FROM t),
 v AS (SELECT * FROM r UNION SELECT k.workflow, src, kind, dst FROM e JOIN k ON src = k.node WHERE e.class = 'Stream' UNION SELECT k.workflow, src, kind, dst FROM e JOIN k ON dst = k.node WHERE e.class = 'Stream'),
 x AS (SELECT workflow, src AS node FROM v UNION SELECT workflow, dst FROM v UNION SELECT workflow, node FROM c), m AS (SELECT workflow, count(*) edges FROM v GROUP BY 1)
  SELECT workflow, count(*) nodes, any_value(coalesce(edges, 0)) edges FROM x LEFT JOIN m USING (workflow) GROUP BY workflow""",
    "etl6_drift": "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'missing' ELSE 'changed' END state FROM part WHERE p_size IN (7, 9) UNION ALL SELECT p_partkey + 1000000, 'extra' FROM part WHERE p_size = 3",
    "join6_locators": """WITH g AS (SELECT 'S' || s_suppkey AS id, 'root/m' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '/d' || (s_suppkey % 5) ELSE '' END || '/' AS r FROM supplier),
  q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'root/m' || (p_partkey % 25) WHEN 1 THEN 'root/m' || (p_partkey % 25) || '/d' || (p_partkey % 5) || '/x/y' || (p_partkey % 9) WHEN 2 THEN 'd' || (p_partkey % 9) || '/' ELSE 'other' || (p_partkey % 7) END locator,
    CASE WHEN p_partkey % 5 = 0 THEN 'table' ELSE 'local_file' END data_type FROM part),
  m AS (SELECT q.*, g.id, length(r) n, CASE WHEN rtrim(locator, '/') = rtrim(r, '/') THEN 'exact' WHEN starts_with(locator, r) THEN 'prefix' WHEN ends_with(r, locator) THEN 'suffix' END step FROM q, g),
  b AS (SELECT *, row_number() OVER (PARTITION BY locator, data_type ORDER BY step, n DESC, id) i FROM m WHERE step IS NOT NULL AND (step = 'exact' OR data_type <> 'table'))
  SELECT q.data_type, q.locator, coalesce(b.id, q.data_type || ':' || q.locator) id, coalesce(step, 'none') step FROM q LEFT JOIN b ON b.locator = q.locator AND b.data_type = q.data_type AND i = 1""",
    "con8_evaluation": _C + """, v AS (SELECT * FROM k WHERE class = 'Eval')
  SELECT node, 'no evidence' issue FROM v WHERE node NOT IN (SELECT dst FROM e WHERE kind = 'measured_by') UNION ALL SELECT node, 'no target' FROM v WHERE node NOT IN (SELECT src FROM e WHERE kind = 'measures')
  UNION ALL SELECT node, 'no ' || x || ' branch' FROM v, (VALUES ('pass'), ('fail')) t(x) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = v.node AND kind = 'default' AND on_case = x)
  UNION ALL SELECT node, 'unknown dimension' FROM v WHERE dimension = 'charm' UNION ALL SELECT node, 'outside an oracle workflow' FROM v WHERE workflow NOT IN ('w1', 'w2', 'w3')""",
    "con14_fields": """SELECT p_partkey node, 'name' AS field, 'required' issue FROM part WHERE p_size % 11 = 0 OR p_name IS NULL UNION ALL SELECT p_partkey, 'size', 'wrong type' FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey, 'mode', 'not allowed' FROM part WHERE p_size % 3 = 2 UNION ALL SELECT p_partkey, 'note', 'required here' FROM part WHERE p_size % 3 = 1 AND p_size % 2 <> 0""",
}
