"""Queries over the shared tables and the SQL that says what they must return."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as fn
from ..operators import graph as G
from ..operators import logs as L
from ..operators import memory as M
from ..operators import rules as R
from ..operators import turns as T
from . import artifacts, documents, etl, grounding, nodes, paths, records, workflows

W = f"TIMESTAMP '{S.AS_OF}' - INTERVAL 7 DAYS"
_T = f"WITH turns AS ({S.TURNS_SQL})"
_P = f"""{_T}, p AS (SELECT p.resolved_intent_id f, c.resolved_intent_id t FROM turns c JOIN turns p ON c.prev_turn_id = p.turn_id
  WHERE c.success AND p.success AND c.resolved_intent_id IS NOT NULL AND p.resolved_intent_id IS NOT NULL AND c.timestamp >= {W}),
 m AS (SELECT f from_intent, t to_intent, count(*) cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY f), 1) pct FROM p GROUP BY f, t)"""
_C = "CASE WHEN k % 5 = 0 THEN [] ELSE ['c' || (k % 4), CASE WHEN k % 7 <> 0 THEN 'd' || (k % 3) END] END"
_F = f"""SELECT resolved_intent_id intent_id, count(*) total, CAST(sum(CAST(success AS INT)) AS BIGINT) success_count, round(avg(CAST(success AS INT)) * 100, 1) success_rate,
  round(avg(reprompt_count), 2) avg_reprompts, round(avg(duration_ms), 0) avg_duration_ms FROM turns WHERE timestamp >= {W} AND resolved_intent_id IS NOT NULL GROUP BY 1"""
_R = f"""SELECT resolved_intent_id intent_id, round(avg(reprompt_count), 2) avg_reprompt, max(reprompt_count) max_reprompt, round(count(*) FILTER (reprompt_count > 0) * 100.0::DOUBLE / count(*), 1) pct_reprompted
  FROM turns WHERE timestamp >= {W} AND resolved_intent_id IS NOT NULL GROUP BY 1 HAVING avg(reprompt_count) > 0"""
_K = """SELECT word, count(*) cnt FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z가-힣]+'))) word FROM conversations) WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 3"""
_E, _REL, _LOG = f"WITH e AS ({S.ENTRIES_SQL}), r AS ({S.RELATIONS_SQL})", S.RELATIONS_SQL, f"WITH l AS ({S.LOGS_SQL})"
_ST = f"WITH s AS ({S.STREAMS_SQL}), m AS (SELECT o_orderpriority workflow, 'run/' || o_orderkey node FROM orders), a AS ({S.ARTIFACTS_SQL})"
_OWN = """SELECT id, 0.4::DOUBLE * coalesce(greatest(0, least(1, CAST(confidence AS DOUBLE))), 0.5) + CASE WHEN validation IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * coalesce(greatest(0, least(1, CAST(coverage AS DOUBLE))), 0.5)
  + 0.2::DOUBLE * ((version IS NOT NULL)::INT + (timestamp IS NOT NULL)::INT + (author IS NOT NULL)::INT + (validation IS NOT NULL)::INT + (coverage IS NOT NULL)::INT + (confidence IS NOT NULL)::INT) / 6 trust FROM a"""
_EV = "SELECT c.src, p.dst, min(c.dst) via FROM s c JOIN s p ON c.dst = p.src WHERE c.kind = 'consumed_by' AND p.kind = 'produces_to' AND c.src <> p.dst GROUP BY 1, 2"
_SUP = """SELECT workflow, artifact, CAST(sum(p) AS BIGINT) producers, CAST(sum(1 - p) AS BIGINT) consumers FROM (SELECT DISTINCT src node, dst artifact, 1 p FROM s WHERE kind = 'produces_to' UNION ALL SELECT DISTINCT dst, src, 0 FROM s WHERE kind = 'consumed_by') JOIN m USING (node) GROUP BY 1, 2"""
_CL = f"""WITH RECURSIVE e AS ({S.CONTROL_SQL}), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"""


def _values(spark, d):
    p = S.read(spark, d, "part")
    return p.select(F.concat(F.lit("part/"), "p_partkey").alias("subject"), F.explode(F.array(
        F.struct(F.lit("size").alias("property"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("brand").alias("property"), F.col("p_brand").alias("value")),
    )).alias("v")).select("subject", "v.*")


def _rules(spark, d):
    v = _values(spark, d)
    ranges = spark.createDataFrame([("size", 5.0, 40.0)], "property string, low double, high double")
    allowed = v.where("property = 'brand'").groupBy("property").agg(F.array(F.min("value"), F.max("value")).alias("allowed"))
    return [("range", "error", R.numeric_range(v, ranges)), ("brand", "warning", R.enumeration(v, allowed))]


def _cardinality(spark, d):
    o, li = S.read(spark, d, "orders"), S.read(spark, d, "lineitem")
    rules = spark.createDataFrame([("Run", "input", 2, 5)], "class string, property string, least int, most int")
    targets = o.select(F.col("o_orderkey").alias("subject"), F.lit("Run").alias("class"))
    return R.cardinality(targets, li.select(F.col("l_orderkey").alias("subject"), F.lit("input").alias("property"), F.col("l_partkey").alias("value")), rules)


def _nodes(spark, d):
    b = S.read(spark, d, "benchmark")
    i = F.col("item_id")
    tags = F.array(F.when(i % 2 == 0, "en").otherwise("fr"), F.concat(F.lit("src"), (i % 20).cast("string")))
    return b.select(i.alias("node"), "text", tags.alias("tags"), F.when(i % 5 == 0, F.array(F.lit("user-decision"), F.lit("trouble"))).alias("types"))


def _tagged(spark, d):
    """Entries with their language as a tag and their source as a module."""
    return S.entries(spark, d).select("id", "type", F.lit(None).cast("string").alias("title"), "text", F.array("lang").alias("tags"), F.col("source").alias("module"), "created_at")


def _measures(s, d):
    """Each order status measures the workflows that it occurs in; one edge leads to a workflow without members."""
    o = S.read(s, d, "orders").select(F.concat(F.lit("eval/"), "o_orderstatus").alias("node"), F.col("o_orderpriority").alias("workflow")).distinct()
    return o.unionByName(s.createDataFrame([("eval/none", "none")], "node string, workflow string"))


def _part_trust(s, d):
    return G.own_trust(S.artifacts(s, d))


QUERIES = {
    "flt2_unresolved": lambda s, d: T.unresolved(S.turns(s, d)).select("turn_id", "session_id"),
    "agg1_transition_matrix": lambda s, d: T.transition_matrix(S.turns(s, d)),
    "agg2_factored": lambda s, d: T.factored(S.turns(s, d)),
    "agg3_funnel": lambda s, d: T.funnel(S.turns(s, d)),
    "agg4_reprompt_rate": lambda s, d: T.reprompt_rate(S.turns(s, d)),
    "agg5_escalation": lambda s, d: T.escalation(S.turns(s, d), min_accuracy=0.5),
    "agg6_suggestions": lambda s, d: T.suggestions(S.turns(s, d), least=20.0),
    "agg7_slot_tuning": lambda s, d: T.slot_tuning(S.turns(s, d), above=0.9),
    "agg8_keywords": lambda s, d: T.keyword_candidates(S.utterances(s, d)).select("word", "cnt"),
    "agg9_feedback": lambda s, d: T.feedback(S.turns(s, d), S.utterances(s, d)),
    "agg10_counters": lambda s, d: L.counters(S.log_lines(s, d)),
    "agg11_hotspots": lambda s, d: L.hotspots(S.log_lines(s, d)),
    "agg12_repeated": lambda s, d: L.repeated(S.log_lines(s, d).unionByName(S.log_lines(s, d).where("line % 10 = 0"))),
    "top1_top_counters": lambda s, d: L.top(L.counters(S.log_lines(s, d)), "cnt", "scope", "dim", "value"),
    "agg13_stats": lambda s, d: M.stats(S.entries(s, d)),
    "agg14_next_ids": lambda s, d: M.next_ids(S.entries(s, d)),
    "mem1_validate": lambda s, d: M.validate(S.entries(s, d).withColumn("type", F.when(F.substring("created_at", -1, 1) != "7", F.col("type")).otherwise("note"))),
    "mem2_relations": lambda s, d: M.relations(S.entries(s, d)).drop("src_type"),
    "mem3_traverse": lambda s, d: M.traverse(M.relations(S.entries(s, d)), S.entries(s, d).where("type = 'trouble'"), depth=3),
    "mem4_triples": lambda s, d: M.triples(S.entries(s, d)),
    "mem5_typed_relations": lambda s, d: M.typed_violations(S.entries(s, d)),
    "mem6_rolled_back": lambda s, d: M.rolled_back(S.entries(s, d)),
    "mem7_current_release": lambda s, d: M.current_release(S.entries(s, d)),
    "mem8_validity": lambda s, d: M.validity(S.entries(s, d)),
    "mem10_revalidation": lambda s, d: M.revalidation(S.entries(s, d)),
    "mem12_relevance": lambda s, d: M.relevance(_nodes(s, d), _tagged(s, d)),
    "grf1_evidence": lambda s, d: G.evidence(S.streams(s, d)),
    "grf2_own_trust": lambda s, d: _part_trust(s, d).select("id", F.round("trust", 4).alias("trust")),
    "grf3_propagate": lambda s, d: G.propagate(G.own_trust(S.artifacts(s, d)).unionByName(S.read(s, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.lit(0.5).alias("trust"))), G.evidence(S.streams(s, d))).select("id", F.round("trust", 4).alias("trust")),
    "grf5_workflow_trust": lambda s, d: G.workflow_trust(S.streams(s, d), S.membership(s, d), _part_trust(s, d)).select("workflow", F.round("trust", 4).alias("trust")),
    "grf6_decisions": lambda s, d: G.decisions(_measures(s, d), G.workflow_trust(S.streams(s, d), S.membership(s, d), _part_trust(s, d)), threshold=0.55).select("node", "workflow", "decision"),
    "grf9_terminals": lambda s, d: G.terminals(S.streams(s, d)),
    "grf10_multi_outgoing": lambda s, d: G.multi_outgoing(S.streams(s, d)),
    "grf11_shared_nodes": lambda s, d: G.shared_nodes(S.read(s, d, "lineitem").select(F.concat(F.lit("part/"), "l_partkey").alias("node"), F.col("l_suppkey").alias("workflow"))),
    "grf12_closure": lambda s, d: G.closure(S.control(s, d)),
    "grf15_loops": lambda s, d: G.loops(S.control(s, d), S.read(s, d, "nation").where("n_nationkey % 10 = 3").select(F.col("n_nationkey").alias("node"))),
    "grf16_uncovered": lambda s, d: G.uncovered(S.artifacts(s, d)),
    "agg15_supply": lambda s, d: G.supply(S.streams(s, d), S.membership(s, d)),
    "agg16_gaps": lambda s, d: G.gaps(S.streams(s, d), S.membership(s, d)),
    "agg18_index": lambda s, d: G.index(S.streams(s, d), S.membership(s, d)),
    "con7_degrees": lambda s, d: G.degrees(S.streams(s, d)),
    "con1_cardinality": lambda s, d: _cardinality(s, d),
    "con3_range": lambda s, d: _rules(s, d)[0][2],
    "con13_summary": lambda s, d: R.summary(*_rules(s, d)),
    "top5_successors": lambda s, d: G.successors(S.read(s, d, "conversations"), by="conv_id", order=("turn",), node="turn").groupBy("src", "dst").agg(F.count("*").alias("cnt")),
    "top7_levels": lambda s, d: G.levels(S.streams(s, d)),
    "fn2_language": lambda s, d: S.read(s, d, "documents").select("doc_id", fn.language(F.col("text")).alias("language")),
    "fn6_locator": lambda s, d: S.read(s, d, "pages").select("page_id", fn.locator(F.col("url")).alias("locator")),
    "fn12_tokens": lambda s, d: S.read(s, d, "benchmark").select("item_id", F.size(fn.tokens(F.col("text"))).alias("n")),
}
ORACLE_SQL = {
    "flt2_unresolved": f"{_T} SELECT turn_id, session_id FROM turns WHERE resolved_intent_id IS NULL AND timestamp >= {W}",
    "agg1_transition_matrix": f"{_P} SELECT * FROM m",
    "agg2_factored": f"""{_T}, q AS (SELECT p.resolved_intent_id f, c.resolved_intent_id t, unnest(p.c) fc, c.c FROM (SELECT *, {_C} c FROM turns) c JOIN (SELECT *, {_C} c FROM turns) p ON c.prev_turn_id = p.turn_id
      WHERE c.success AND p.success AND c.resolved_intent_id IS NOT NULL AND p.resolved_intent_id IS NOT NULL AND c.timestamp >= {W} AND p.timestamp >= {W}), u AS (SELECT f, fc, t, unnest(c) tc FROM q)
      SELECT f from_intent, coalesce(fc, '_no_concept') from_target_concept, t to_intent, coalesce(tc, '_no_concept') to_target_concept, count(*) cnt FROM u GROUP BY ALL""",
    "agg3_funnel": f"{_T} {_F}",
    "agg4_reprompt_rate": f"{_T} {_R}",
    "agg5_escalation": f"{_T} SELECT * FROM ({_F}) WHERE total >= 200 AND success_rate >= 50",
    "agg6_suggestions": f"{_P} SELECT *, from_intent || ' -> ' || to_intent suggestion FROM m WHERE pct >= 20",
    "agg7_slot_tuning": f"{_T} SELECT * FROM ({_R}) WHERE avg_reprompt > 0.9",
    "agg8_keywords": _K,
    "agg9_feedback": f"""{_P} SELECT 'matrix' kind, from_intent || ' -> ' || to_intent subject, pct score FROM m WHERE pct >= 40 UNION ALL SELECT 'slots', intent_id, avg_reprompt FROM ({_R}) WHERE avg_reprompt > 1.5
      UNION ALL SELECT 'keyword', word, CAST(cnt AS DOUBLE) FROM ({_K}) UNION ALL SELECT 'escalation', intent_id, success_rate FROM ({_F}) WHERE total >= 200 AND success_rate >= 85""",
    "agg10_counters": f"""{_LOG} SELECT scope, dim, value, count(*) cnt FROM (SELECT scope, 'status' dim, status AS value FROM l UNION ALL SELECT scope, 'event', event_type FROM l UNION ALL SELECT scope, 'workflow', workflow FROM l)
      WHERE value IS NOT NULL GROUP BY ALL""",
    "agg11_hotspots": f"""{_LOG} SELECT hotspot, count(*) cnt FROM (SELECT 'workflow:' || workflow hotspot FROM l WHERE status = 'failed' AND workflow IS NOT NULL UNION ALL SELECT 'node:' || node FROM l WHERE status = 'failed' AND node IS NOT NULL
      UNION ALL SELECT scope || ':unknown' FROM l WHERE status = 'failed' AND workflow IS NULL AND node IS NULL) GROUP BY 1""",
    "agg12_repeated": f"{_LOG} SELECT scope, id, CAST(2 AS BIGINT) cnt FROM l WHERE CAST(id AS BIGINT) % 10 = 0",
    "agg13_stats": f"{_E} SELECT type, count(*) cnt FROM e GROUP BY 1",
    "agg14_next_ids": f"{_E} SELECT 'E' prefix, max(i) + 1 AS next FROM e",
    "mem1_validate": f"{_E} SELECT id, 'unknown type note' issue FROM e WHERE i % 10 = 7 UNION ALL SELECT id, 'missing text' FROM e WHERE text IS NULL OR trim(text) = ''",
    "mem2_relations": _REL,
    "mem3_traverse": f"""{_E}, d0 AS (SELECT id root, id node FROM e WHERE type = 'trouble'), d1 AS (SELECT DISTINCT root, dst node FROM d0 JOIN r ON node = src), d2 AS (SELECT DISTINCT root, dst node FROM d1 JOIN r ON node = src),
      d3 AS (SELECT DISTINCT root, dst node FROM d2 JOIN r ON node = src) SELECT root, node, min(depth) depth FROM (SELECT *, 0 depth FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY 1, 2""",
    "mem4_triples": f"""{_E} SELECT src s, kind p, CASE WHEN e.id IS NOT NULL THEN dst ELSE 'external:' || dst END o FROM r LEFT JOIN e ON dst = e.id UNION ALL SELECT id, 'type', type FROM e UNION ALL SELECT id, 'lang', lang FROM e WHERE lang IS NOT NULL
      UNION ALL SELECT id, 'source', source FROM e WHERE source IS NOT NULL UNION ALL SELECT id, 'created_at', created_at FROM e""",
    "mem5_typed_relations": f"""{_E} SELECT src, a.type src_type, kind, dst, b.type dst_type FROM r JOIN e a ON src = a.id JOIN e b ON dst = b.id
      WHERE (kind = 'invalidated-by' AND b.type <> 'release-note') OR (kind = 'resolved-by' AND b.type <> 'trouble') OR (kind = 'rolls-back' AND (a.type <> 'release-note' OR b.type <> 'release-note'))""",
    "mem6_rolled_back": f"{_E} SELECT DISTINCT dst id FROM r WHERE kind = 'rolls-back'",
    "mem7_current_release": f"{_E} SELECT id, coalesce(released_at, created_at) released FROM e WHERE type = 'release-note' AND coalesce(note_kind, 'release') <> 'rollback' AND id NOT IN (SELECT dst FROM r WHERE kind = 'rolls-back') ORDER BY 2 DESC, id LIMIT 1",
    "mem8_validity": f"{_E} SELECT src, kind, dst, CASE WHEN dst IN (SELECT dst FROM r WHERE kind = 'rolls-back') THEN 'suspended' ELSE 'active' END status FROM r WHERE kind IN ('invalidated-by', 'verified-in')",
    "mem10_revalidation": f"{_E} SELECT i.src, i.dst, b.src rollback FROM r i JOIN r b ON i.dst = b.dst WHERE i.kind = 'invalidated-by' AND b.kind = 'rolls-back'",
    "grf1_evidence": f"{_ST} {_EV}",
    "grf2_own_trust": f"{_ST} SELECT id, round(trust, 4) trust FROM ({_OWN})",
    "grf3_propagate": f"""{_ST}, o AS ({_OWN}), t0 AS (SELECT * FROM o UNION ALL SELECT 'customer/' || c_custkey, 0.5::DOUBLE FROM customer), ev AS ({_EV}), x AS (SELECT dst, avg(trust) m FROM ev JOIN t0 ON src = id GROUP BY 1)
      SELECT id, round(CASE WHEN m IS NULL THEN trust ELSE 0.7::DOUBLE * trust + 0.3::DOUBLE * m END, 4) trust FROM t0 LEFT JOIN x ON id = dst""",
    "grf5_workflow_trust": f"{_ST} SELECT workflow, round(avg(trust), 4) trust FROM s JOIN m ON dst = node JOIN ({_OWN}) o ON src = o.id WHERE kind = 'consumed_by' GROUP BY 1",
    "grf6_decisions": f"""{_ST}, w AS (SELECT workflow, avg(trust) trust FROM s JOIN m ON dst = node JOIN ({_OWN}) o ON src = o.id WHERE kind = 'consumed_by' GROUP BY 1)
      SELECT x.node, x.workflow, CASE WHEN trust IS NULL THEN 'insufficient-signal' WHEN trust >= 0.55 THEN 'pass' ELSE 'fail' END decision FROM (SELECT DISTINCT 'eval/' || o_orderstatus node, o_orderpriority workflow FROM orders UNION ALL SELECT 'eval/none', 'none') x LEFT JOIN w USING (workflow)""",
    "grf9_terminals": f"{_ST} SELECT DISTINCT src node, 'entry' AS role FROM s WHERE src NOT IN (SELECT dst FROM s) UNION ALL SELECT DISTINCT dst, 'exit' FROM s WHERE dst NOT IN (SELECT src FROM s)",
    "grf10_multi_outgoing": f"{_ST} SELECT src node, count(DISTINCT dst) targets FROM s GROUP BY 1 HAVING count(DISTINCT dst) >= 2",
    "grf11_shared_nodes": "SELECT 'part/' || l_partkey node, count(DISTINCT l_suppkey) owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "grf12_closure": f"{_CL} SELECT * FROM c",
    "grf15_loops": f"""{_CL}, k AS (SELECT a.src node, min(a.dst) component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
      SELECT node, component FROM k WHERE component NOT IN (SELECT component FROM k WHERE node % 10 = 3)""",
    "grf16_uncovered": f"{_ST} SELECT id FROM a WHERE coalesce(author, version, timestamp, validation, CAST(coverage AS VARCHAR), CAST(confidence AS VARCHAR)) IS NULL",
    "agg15_supply": f"{_ST} {_SUP}",
    "agg16_gaps": f"{_ST} SELECT workflow, artifact, CASE WHEN consumers = 0 THEN 'unconsumed' ELSE 'external' END gap FROM ({_SUP}) WHERE producers = 0 OR consumers = 0",
    "agg18_index": f"{_ST} SELECT workflow, nodes, artifacts FROM (SELECT workflow, count(DISTINCT node) nodes FROM m GROUP BY 1) JOIN (SELECT workflow, count(*) artifacts FROM ({_SUP}) GROUP BY 1) USING (workflow)",
    "con7_degrees": f"{_ST} SELECT node, CAST(sum(i) AS BIGINT) n_in, CAST(sum(1 - i) AS BIGINT) n_out FROM (SELECT src node, 0 i FROM s UNION ALL SELECT dst, 1 FROM s) GROUP BY 1",
    "con1_cardinality": "SELECT o_orderkey subject, 'input' property, count(l_orderkey) n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_orderkey) NOT BETWEEN 2 AND 5",
    "con3_range": "SELECT 'part/' || p_partkey subject, 'size' property, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size NOT BETWEEN 5 AND 40",
    "con13_summary": """SELECT 'range' AS name, 'error' severity, count(*) violations, count(*) = 0 ok FROM part WHERE p_size NOT BETWEEN 5 AND 40
      UNION ALL SELECT 'brand', 'warning', count(*), true FROM part WHERE p_brand NOT IN ((SELECT min(p_brand) FROM part), (SELECT max(p_brand) FROM part))""",
    "top5_successors": "SELECT src, dst, count(*) cnt FROM (SELECT turn src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) dst FROM conversations) WHERE dst IS NOT NULL GROUP BY 1, 2",
    "top7_levels": f"{_ST} SELECT src node, 0 AS level FROM s WHERE src NOT IN (SELECT dst FROM s) GROUP BY 1 UNION ALL SELECT DISTINCT dst, 1 FROM s WHERE kind = 'consumed_by' UNION ALL SELECT dst, max(CASE WHEN src IN (SELECT dst FROM s WHERE kind = 'consumed_by') THEN 2 ELSE 1 END) FROM s WHERE kind = 'produces_to' GROUP BY 1",
    "fn2_language": """SELECT doc_id, CASE WHEN ko + en = 0 THEN 'unknown' WHEN ko / (ko + en) >= 0.7 THEN 'ko' WHEN ko / (ko + en) <= 0.3 THEN 'en' ELSE 'mixed' END AS language
      FROM (SELECT doc_id, length(regexp_replace(text, '[^가-힣]', '', 'g')) ko, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) en FROM documents)""",
    "fn6_locator": r"SELECT page_id, regexp_replace(regexp_replace(replace(trim(url), '\', '/'), '/+', '/', 'g'), '^(\.{1,2}/)+', '') locator FROM pages",
    "fn12_tokens": "SELECT item_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.-]{3,}'), lambda x: lower(x)))) AS INTEGER) n FROM benchmark",
}
ORACLE_SQL["top1_top_counters"] = f"SELECT * FROM ({ORACLE_SQL['agg10_counters']}) ORDER BY cnt DESC, scope, dim, value LIMIT 10"
QUERIES |= workflows.QUERIES | grounding.QUERIES | records.QUERIES | etl.QUERIES | artifacts.QUERIES | paths.QUERIES | nodes.QUERIES | documents.QUERIES
ORACLE_SQL |= workflows.ORACLE_SQL | grounding.ORACLE_SQL | records.ORACLE_SQL | etl.ORACLE_SQL | artifacts.ORACLE_SQL | paths.ORACLE_SQL | nodes.ORACLE_SQL | documents.ORACLE_SQL
ORACLE_SQL["grf7_repository_trust"] = f"{_ST} SELECT round(avg(round(trust, 6)), 4) trust, count(*) measured FROM ({_OWN}) WHERE id NOT LIKE '%3'"
