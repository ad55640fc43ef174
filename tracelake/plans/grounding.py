"""Grounding over the shared tables: every conversation turn is an utterance, the nations are the registry of intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding as G
from ..schemas import read

#: SQL that Spark and DuckDB both run. Some turns name entities or priorities, some intents are unknown, some sessions have runs.
UTTERANCES_SQL = """SELECT CAST(conv_id AS VARCHAR(20)) AS session_id, conv_id || '-' || turn AS turn_id,
  CASE conv_id % 6 WHEN 0 THEN text WHEN 1 THEN '  ' || text || '  Ticket-' || conv_id || ' , RUN-' || turn || ' ' WHEN 2 THEN 'wf-' || conv_id || ' is high ' || text
    WHEN 3 THEN text || ' at H' || turn || ' gate ' WHEN 4 THEN text || ' gate-' || turn || ' low' ELSE '' END AS utterance,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN 'UNKNOWN' WHEN turn % 3 = 0 THEN 'CHINA' WHEN turn % 3 = 1 THEN 'JAPAN' ELSE 'FRANCE' END AS named, (conv_id + turn) % 31 AS pick,
  CASE WHEN conv_id % 5 = 0 THEN 'run-s' || conv_id END AS run, CASE conv_id % 4 WHEN 0 THEN 'ticket-' || conv_id WHEN 1 THEN 'manifest-a' WHEN 2 THEN 'other' END AS last_referenced_entity FROM conversations"""
SPECS_SQL = """SELECT n_nationkey AS intent_key, pos, slot_name, slot_type, required, fill_policy, default_value FROM nation CROSS JOIN (VALUES
  (0, 'ticket_ref', 'entity_ref', true, 'ask', NULL), (1, 'new_priority', 'enum', true, 'default', 'normal'), (2, 'run_ref', 'entity_ref', false, NULL, NULL),
  (3, 'gate_ref', 'entity_ref', NULL, 'ask', NULL), (4, 'task_description', 'free_text', true, 'ask', NULL), (5, 'workflow_ref', 'entity_ref', true, 'default', 'wf-main'),
  (6, 'note', 'free_text', true, 'ask', 'unused'), (7, 'ref', 'entity_ref', true, 'default', 'gate-x')) v(pos, slot_name, slot_type, required, fill_policy, default_value)
  WHERE (n_nationkey * 7 + pos * 3) % 4 <> 1"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = UTTERANCES_SQL.replace("VARCHAR(20)", "STRING").replace("FROM conversations", "FROM {c}")
    u = spark.sql(sql, c=read(spark, sf_dir, "conversations"))
    return u.select("session_id", "turn_id", "utterance", F.concat(F.lit("I"), F.col("pick")).alias("intent_id"), F.array_compact(F.array("run")).alias("run_ids"), "last_referenced_entity")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intent for each nation; one without slots has null for them."""
    s = spark.sql(SPECS_SQL.replace("FROM nation", "FROM {n}"), n=read(spark, sf_dir, "nation"))
    specs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "slot_name", "slot_type", "required", "fill_policy", "default_value"))), lambda x: F.struct(*[x[c].alias(c) for c in ("slot_name", "slot_type", "required", "fill_policy", "default_value")]))
    by_key = s.groupBy("intent_key").agg(specs.alias("slot_specs"))
    n = read(spark, sf_dir, "nation").join(by_key, F.col("n_nationkey") == F.col("intent_key"), "left")
    words = F.when(F.col("n_regionkey") > 0, F.split(F.lower("n_name"), " "))
    rows = n.select(F.concat(F.lit("I"), F.col("n_nationkey")).alias("intent_id"), "slot_specs", words.alias("trigger_keywords"), F.lit(None).cast("array<string>").alias("example_utterances"))
    return G.registry(rows)


def _filled(spark, d):
    return G.fill_slots(G.with_intent(utterances(spark, d), intents(spark, d)))


def _told(slots):
    return F.array_join(F.transform(slots, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")


def _specs(spark, d):
    i = intents(spark, d).select("intent_id", F.size("trigger_keywords").alias("n_keywords"), F.posexplode("slot_specs").alias("at", "s"))
    return i.select("intent_id", "n_keywords", "at", "s.slot_name", "s.required", "s.fill_policy", "s.default_value")


def _keywords(spark, d):
    return G.trigger_keywords(utterances(spark, d).select("intent_id"), intents(spark, d)).groupBy("intent_id").agg(F.count("*").alias("n"), F.max(F.array_join("trigger_keywords", " ")).alias("keywords"))


def _cells(spark, d):
    """A cell for each nation and order priority that meet, its status by the number of orders."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("priority"))
    cell = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("/"), F.col("o_orderpriority"))
    return G.cells(n.select(cell.alias("cell_id"), F.when(F.col("priority") % 3 == 0, "filled").when(F.col("priority") % 3 == 1, "planned").otherwise("rejected").alias("status"), "priority"))


def _commands(spark, d):
    return G.ground(utterances(spark, d), intents(spark, d))


QUERIES = {
    "src8_registry": _specs,
    "flt4_cells": _cells,
    "flt5_keywords": _keywords,
    "grd1_slots": lambda s, d: _filled(s, d).select("turn_id", _told(F.col("slots")).alias("slots"), F.array_join("missing", ";").alias("missing")),
    "grd3_target": lambda s, d: G.resolve_target(_filled(s, d)).select("turn_id", "target_id", F.array_join("target_concepts", ";").alias("concepts")),
    "grd4_violations": lambda s, d: G.violations(_filled(s, d)).select("turn_id", F.array_join("violations", ";").alias("violations")),
    "grd5_commands": lambda s, d: _commands(s, d).select("turn_id", "intent_id", "target_id", F.size("slots").alias("n_slots"), "confidence", "tier", "reprompt_needed", F.array_join("reprompt_slots", ";").alias("reprompt_slots")),
    "snk1_turns": lambda s, d: G.turn_records(_commands(s, d)).select("type", "turn_id", "session_id", "utterance", "resolved_intent_id", "resolved_target_entity_id", "slots_filled", "reprompt_count", "success"),
}

_U = f"WITH u AS (SELECT *, 'I' || pick AS intent_id, trim(regexp_replace(utterance, '\\s+', ' ', 'g')) AS norm FROM ({UTTERANCES_SQL})),"
#: One row for each utterance and slot of its intent, with the value found.
_V = (
    _U
    + f""" s AS (SELECT 'I' || intent_key AS intent_id, pos, slot_name, slot_type, coalesce(required, false) required, coalesce(fill_policy, 'ask') fill_policy, default_value FROM ({SPECS_SQL})),
 x AS (SELECT u.*, s.* EXCLUDE (intent_id), CASE
   WHEN slot_type = 'entity_ref' AND slot_name = 'ticket_ref' THEN lower(nullif(regexp_extract(norm, '(?i)\\bticket-\\w+\\b'), ''))
   WHEN slot_type = 'entity_ref' AND slot_name = 'run_ref' THEN lower(nullif(regexp_extract(norm, '(?i)\\brun-\\w+\\b'), ''))
   WHEN slot_type = 'entity_ref' AND slot_name = 'workflow_ref' THEN lower(nullif(regexp_extract(norm, '(?i)\\bwf-\\w+\\b'), ''))
   WHEN slot_type = 'entity_ref' AND slot_name = 'gate_ref' THEN lower(nullif(regexp_extract(norm, '(?i)\\bh\\d+\\s*gate\\b|\\bgate-\\w+\\b'), ''))
   WHEN slot_name = 'new_priority' THEN CASE WHEN contains(lower(norm), 'high') THEN 'high' WHEN contains(lower(norm), 'low') THEN 'low' WHEN contains(lower(norm), 'normal') THEN 'normal' WHEN contains(lower(norm), 'urgent') THEN 'urgent' END
   WHEN slot_type = 'free_text' AND slot_name = 'task_description' THEN nullif(norm, '') END said,
   CASE WHEN slot_name = 'run_ref' THEN run WHEN slot_name IN ('workflow_ref', 'gate_ref', 'ticket_ref') THEN last_referenced_entity END known, CASE WHEN fill_policy = 'default' THEN default_value END given
  FROM u JOIN s USING (intent_id)),
 v AS (SELECT *, coalesce(said, known, given) AS value FROM x),
 f AS (SELECT turn_id, string_agg(slot_name || '=' || value, ';' ORDER BY pos) FILTER (value IS NOT NULL) slots, string_agg(slot_name, ';' ORDER BY pos) FILTER (value IS NULL AND required) missing,
   CAST(count(value) AS INTEGER) n_slots, string_agg(intent_id || ' requires slot ''' || slot_name || '''', ';' ORDER BY pos) FILTER (value IS NULL AND required) violations,
   max(value) FILTER (slot_name = 'ticket_ref') t, max(value) FILTER (slot_name = 'run_ref') r, max(value) FILTER (slot_name = 'workflow_ref') w, max(value) FILTER (slot_name = 'gate_ref') g, max(value) FILTER (slot_name = 'ref') o,
   string_agg('"' || slot_name || '":"' || replace(replace(value, chr(10), '\\n'), '"', '\\"') || '"', ',' ORDER BY pos) FILTER (value IS NOT NULL) js FROM v GROUP BY turn_id),
 k AS (SELECT u.*, f.* EXCLUDE (turn_id), i.n_nationkey IS NOT NULL AS is_known, CASE WHEN i.n_nationkey IS NOT NULL THEN coalesce(t, r, w, g, o, last_referenced_entity) END target_id FROM u LEFT JOIN f USING (turn_id) LEFT JOIN nation i ON u.intent_id = 'I' || i.n_nationkey),
 z AS (SELECT turn_id, string_agg(slot_name, ';' ORDER BY late, pos) again, CAST(count(*) AS INTEGER) n_again FROM (SELECT turn_id, slot_name, pos, NOT (value IS NULL AND required) late FROM v WHERE value IS NULL AND required
   OR EXISTS (SELECT 1 FROM v m WHERE m.turn_id = v.turn_id AND m.value IS NULL AND m.required AND contains(m.intent_id || ' requires slot ''' || m.slot_name || '''', v.slot_name))) GROUP BY turn_id)
"""
)
ORACLE_SQL = {
    "src8_registry": f"""SELECT 'I' || intent_key AS intent_id, CASE WHEN n_regionkey > 0 THEN len(string_split(n_name, ' ')) ELSE 0 END n_keywords, CAST(row_number() OVER (PARTITION BY intent_key ORDER BY pos) - 1 AS INTEGER) AS at, slot_name,
  coalesce(required, false) required, coalesce(fill_policy, 'ask') fill_policy, default_value FROM ({SPECS_SQL}) JOIN nation ON n_nationkey = intent_key""",
    "flt4_cells": """SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '/' || o_orderpriority cell_id, 'filled' status, count(*) priority FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority HAVING count(*) % 3 = 0""",
    "flt5_keywords": _U + " k AS (SELECT intent_id, count(*) n FROM u GROUP BY 1) SELECT intent_id, n, CASE WHEN n_regionkey > 0 THEN lower(n_name) ELSE '' END keywords FROM k LEFT JOIN nation ON intent_id = 'I' || n_nationkey",
    "grd1_slots": _V + "SELECT turn_id, coalesce(slots, '') slots, coalesce(missing, '') missing FROM k",
    "grd3_target": _V + """SELECT turn_id, target_id, CASE WHEN regexp_matches(target_id, '(?i)^ticket-\\d+$') THEN 'TicketEvent' WHEN regexp_matches(target_id, '(?i)^run-\\w+$') THEN 'RunContext' WHEN regexp_matches(target_id, '(?i)^wf-\\w+$') THEN 'WorkflowEntity'
  WHEN regexp_matches(target_id, '(?i)^gate-\\w+$') THEN 'RunContext;HITLGateContext' WHEN regexp_matches(target_id, '(?i)^manifest-\\w+$') THEN 'RunManifest' ELSE '' END concepts FROM k""",
    "grd4_violations": _V + "SELECT turn_id, coalesce(violations, '') violations FROM k",
    "grd5_commands": _V + """SELECT turn_id, intent_id, target_id, coalesce(n_slots, 0) n_slots, CASE WHEN is_known THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END confidence, 'registry' tier, missing IS NOT NULL reprompt_needed, coalesce(again, '') reprompt_slots
  FROM k LEFT JOIN z USING (turn_id)""",
    "snk1_turns": _V + """SELECT 'turn' AS type, turn_id, session_id, utterance, intent_id resolved_intent_id, target_id resolved_target_entity_id, '{' || coalesce(js, '') || '}' slots_filled, coalesce(n_again, 0) reprompt_count, missing IS NULL success
  FROM k LEFT JOIN z USING (turn_id)""",
}
