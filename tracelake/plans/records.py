"""Queries over entries, releases, logs and triples, and the SQL that says what they must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import etl as E
from ..operators import graph as G
from ..operators import logs as L
from ..operators import memory as M
from ..schemas import read

#: A node is a triple of its type, an edge three or four. SQL that Spark and DuckDB both run. Runs of every ninth order are not declared.
TRIPLES_SQL = """SELECT 'part/' || p_partkey AS s, 'type' AS p, CASE WHEN p_size % 2 = 0 THEN 'Artifact' ELSE 'Directory' END AS o FROM part
  UNION ALL SELECT 'part/' || p_partkey, 'type', 'Resource' FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT 'part/' || p_partkey, CASE p_size % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'title' ELSE 'prefLabel' END, p_name FROM part WHERE p_size % 5 <> 0
  UNION ALL SELECT 'part/' || p_partkey, 'ref', 'doc-' || p_size || CASE p_size % 3 WHEN 0 THEN '.yaml#x' WHEN 1 THEN '.yml' ELSE '.md' END FROM part
  UNION ALL SELECT 'run/' || o_orderkey, 'type', 'Execution' FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT 'edge/' || l_orderkey || '-' || l_linenumber, 'type', 'Stream' FROM lineitem
  UNION ALL SELECT 'edge/' || l_orderkey || '-' || l_linenumber, 'from', 'part/' || l_partkey FROM lineitem
  UNION ALL SELECT 'edge/' || l_orderkey || '-' || l_linenumber, 'to', 'run/' || l_orderkey FROM lineitem
  UNION ALL SELECT 'edge/' || l_orderkey || '-' || l_linenumber, 'streamType', 'consumed_by' FROM lineitem WHERE l_linenumber < 5
  UNION ALL SELECT 'edge/' || l_orderkey || '-' || l_linenumber, 'criteria', l_returnflag FROM lineitem WHERE l_linenumber = 2"""
#: What carried out an order, with what it declares.
EXECUTIONS_SQL = """SELECT 'run/' || o_orderkey AS node, CASE o_orderkey % 8 WHEN 0 THEN 'human' WHEN 1 THEN 'system' WHEN 2 THEN 'model' WHEN 3 THEN 'user' WHEN 4 THEN 'agent' WHEN 5 THEN 'workflow' WHEN 6 THEN 'odd' END AS said,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'm' END AS method, CASE WHEN o_orderkey % 5 <> 0 THEN 'p' END AS policy, CASE WHEN o_orderkey % 2 = 0 THEN 't' END AS timestamp, o_orderpriority AS workflow, o_orderstatus AS state FROM orders"""


def _sql(spark: SparkSession, d: str, sql: str) -> DataFrame:
    tables = ("part", "orders", "lineitem", "customer")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: read(spark, d, t) for t in tables if f"{{{t}}}" in sql})


def triples(spark, d):
    return _sql(spark, d, TRIPLES_SQL)


def executions(spark, d):
    e = _sql(spark, d, EXECUTIONS_SQL)
    return e.withColumn("subject", G.subject_of(G.legacy_subject(F.col("said"))))


def _full_trust(spark, d):
    """Trust of parts as consumed and of customers, by their balance, as produced, and of what was executed."""
    made = read(spark, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal").cast("double") / 10000)).alias("trust"))
    trust = G.own_trust(S.artifacts(spark, d)).unionByName(made)
    return G.workflow_trust(S.streams(spark, d), S.membership(spark, d), trust, G.execution_trust(executions(spark, d)))


def _values(spark, d):
    """JSON values of every kind."""
    e = read(spark, d, "events")
    i = F.col("event_id")
    k = i % 6
    text = F.when(k == 0, F.concat(F.lit('["a'), i, F.lit('", "b", "c", "d"]'))).when(k == 1, F.concat(F.lit('{"z": '), i, F.lit(', "a": "x"}'))).when(k == 2, F.concat(F.lit('"  t'), i, F.lit(' "'))).when(k == 3, '"  "').when(k == 4, i.cast("string")).otherwise("null")
    return e.select("event_id", F.try_parse_json(text).alias("v"))


def _entries(spark, d):
    return S.entries(spark, d).withColumn("module", F.col("source"))


def _results(spark, d):
    e = S.entries(spark, d)
    i = F.substring("id", 3, 20).cast("bigint")
    return e.select("id", F.when(i % 5 != 0, F.col("type")).alias("type"), F.when(i % 4 == 0, F.lit("halt")).when(i % 4 == 1, F.lit("note")).alias("action"))


def _harnesses(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.concat(F.lit("run/"), "o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("harness"), F.when(F.col("o_orderkey") % 3 == 0, "warn").alias("on_fail"))


def _units(spark, d):
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active")
    return o.select(F.col("o_custkey").alias("workflow"), status.alias("status"))


def _directories(spark, d):
    p = read(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("path"), F.when(F.col("page_id") % 4 != 0, "read").otherwise(" ").alias("role"))


def _nodes(spark, d):
    b = read(spark, d, "benchmark")
    i = F.col("item_id")
    tags = F.array(F.when(i % 2 == 0, "en").otherwise("fr"), F.concat(F.lit("src"), (i % 20).cast("string")))
    return b.select(i.alias("node"), "text", tags.alias("tags"), F.when(i % 5 == 0, F.array(F.lit("user-decision"), F.lit("trouble"))).alias("types"))


def _tagged(spark, d):
    return S.entries(spark, d).select("id", "type", F.lit(None).cast("string").alias("title"), "text", F.array("lang").alias("tags"), F.col("source").alias("module"), "created_at")


def _pack(spark, d):
    edges = M.relations(S.entries(spark, d))
    return M.context_pack(_nodes(spark, d), _tagged(spark, d), edges).select("node", "id", "depth", "score", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def _similar(spark, d):
    """Benchmark items look for documents; every third item only for those of a language or source."""
    b, e = read(spark, d, "benchmark"), read(spark, d, "documents")
    tags = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("en"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))))
    return E.similar(b.select(F.col("item_id").alias("query"), tags.alias("tags"), "text"), e.select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("tags"), "text"))


def _full(spark, d):
    """Entries with ids by type, most of them as they should be, tags and metadata."""
    e = S.entries(spark, d)
    i = F.substring("id", 3, 20).cast("bigint")
    kind = F.when(F.col("type") == "trouble", "trouble-shooting").otherwise(F.col("type"))
    prefix = F.when(i % 13 == 5, "XX-").when(kind == "release-note", "RN-").when(kind == "trouble-shooting", "TS-").when(kind == "user-decision", "UD-").otherwise("EP-")
    meta = F.map_from_arrays(F.array(F.lit("z"), F.lit("a")), F.array(F.col("source"), i.cast("string")))
    rel = F.transform("relations", lambda r: F.struct(r["type"].alias("type"), F.when(r["type"] == "references", F.concat(F.lit("doc-"), r["target"])).otherwise(r["target"]).alias("target")))
    return e.select(F.concat(prefix, i).alias("id"), kind.alias("type"), "created_at", "text", F.when(i % 3 > 0, F.array("lang", "source")).alias("tags"), F.when(i % 4 == 0, meta).alias("metadata"), rel.alias("relations"))


_KINDS = ", ".join(f"'{k}'" for k in M.RELATIONS)
_NAMES = ", ".join(f"'{k}'" for k in (*M.PREFIXES, "note"))
def _related_sql(at):
    """Entries of all types with one relation each, of all kinds; ``at`` writes the choice from a list."""
    kind, relation = at(_NAMES, f"doc_id % {len(M.PREFIXES) + 1} + 1"), at(_KINDS, f"CAST(floor(doc_id / 3) AS BIGINT) % {len(M.RELATIONS)} + 1")
    return f"SELECT 'E-' || doc_id AS id, {kind} AS type, {relation} AS kind, 'E-' || (doc_id * 7 % 1100) AS dst FROM documents"


def _related(spark, d):
    sql = _related_sql(lambda names, i: f"element_at(array({names}), CAST({i} AS INT))")
    rows = spark.sql(sql.replace("FROM documents", "FROM {d}"), d=read(spark, d, "documents"))
    return rows.select("id", "type", F.array(F.struct(F.col("kind").alias("type"), F.col("dst").alias("target"))).alias("relations"))


#: Evidence among 200 parts, several steps deep and with cycles. SQL that Spark and DuckDB both run.
DEEP_SQL = "SELECT 'part/' || (l_partkey % 200) AS src, 'part/' || ((l_partkey * 7 + l_suppkey * 3) % 200) AS dst FROM lineitem WHERE l_partkey % 4 > 0"


def _rounds(spark, d):
    edges = spark.sql(DEEP_SQL.replace("FROM lineitem", "FROM {li}"), li=read(spark, d, "lineitem"))
    return G.propagate(G.own_trust(S.artifacts(spark, d)), edges).select("id", F.round("trust", 6).alias("trust"))


def _documents(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    cases = ['{"a": {}, "phases": [1]}', '{"one": {"id": 1}, "x_own": {}}', '{"phases": {}, "workflows": []}', '{"workflows": [{"phases": []}], "meta": {}, "x-a": {}}', "no { json", '["phases"]', '{"plan": "text"}']
    value = F.get(F.array(*map(F.lit, cases)), (k % 7).cast("int"))
    return o.select(F.concat(F.lit("doc/"), k).alias("path"), value.alias("value"))


QUERIES = {
    "src6_scopes": lambda s, d: L.scope_counts(S.log_lines(s, d)),
    "src9_nodes": lambda s, d: G.nodes_of(triples(s, d)).select("node", F.array_join("types", ",").alias("types")),
    "src9_edges": lambda s, d: G.edges_of(triples(s, d)).select("edge", "class", "src", "dst", "kind", "criteria"),
    "flt7_values": lambda s, d: _values(s, d).select("event_id", L.normalized(F.col("v")).alias("value")),
    "flt9_classes": lambda s, d: G.of_classes(G.nodes_of(triples(s, d)), "Directory", "Resource").select("node"),
    "flt10_scopes": lambda s, d: read(s, d, "lineitem").select(F.concat(F.lit("wf#node/"), "l_returnflag", F.lit("/"), "l_orderkey").alias("n")).select(G.scope_of(F.col("n")).alias("scope"), G.display_id(F.col("n")).alias("name")).groupBy("scope").agg(F.countDistinct("name").alias("names")),
    "flt12_refs": lambda s, d: G.legacy_refs(triples(s, d)),
    "fn17_labels": lambda s, d: G.label_of(triples(s, d)),
    "fn13_subjects": lambda s, d: executions(s, d).select("node", "subject"),
    "agg10_prefixes": lambda s, d: L.prefixes(S.log_lines(s, d).withColumn("value", F.regexp_replace("value", '"id":"', F.concat(F.when(F.col("line") % 3 == 0, F.lit('"id":"TS-')).otherwise(F.lit('"id":"EP_')))))),
    "agg19_status": lambda s, d: M.overall_status(_units(s, d)),
    "agg20_manifest": lambda s, d: M.harness_manifest(_harnesses(s, d)),
    "agg21_fingerprint": lambda s, d: M.fingerprint(S.entries(s, d)),
    "grf4_execution_trust": lambda s, d: G.execution_trust(executions(s, d)).select("node", F.round("trust", 4).alias("trust")),
    "grf5_full_trust": lambda s, d: _full_trust(s, d).select("workflow", F.round("trust", 4).alias("trust")),
    "grf16_without_method": lambda s, d: G.without_method(executions(s, d)),
    "grf17_shapeless": lambda s, d: G.shapeless(_directories(s, d)),
    "mem11_digest": lambda s, d: M.digest(S.entries(s, d)),
    "mem13_context": _pack,
    "grf3_rounds": _rounds,
    "mem5_shapes": lambda s, d: M.relation_issues(_related(s, d)),
    "mem1_prefixes": lambda s, d: M.validate(_full(s, d), prefixes=M.PREFIXES, types=tuple(M.PREFIXES), kinds=M.RELATIONS).where("issue LIKE 'id is not%'"),
    "mem4_full": lambda s, d: M.all_triples(_full(s, d)).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.max(F.substring("o", 1, 40)).alias("greatest")),
    "mem4_full_rows": lambda s, d: M.all_triples(_full(s, d)).where("p <> 'text'"),
    "flt13_legacy": lambda s, d: E.legacy_inputs(_documents(s, d)),
    "fn15_json": lambda s, d: read(s, d, "orders").select("o_orderkey", E.sorted_json(F.struct(F.col("o_orderkey").alias("z"), F.array(F.struct(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("b"), F.struct(F.lit(1).alias("y"), F.lit("x").alias("c")).alias("d"))).alias("a"))).alias("json")),
    "mem14_similar": lambda s, d: _similar(s, d).select("query", "id", F.round("score", 6).alias("score"), "rank"),
    "mem15_follow_up": lambda s, d: M.follow_up(_entries(s, d)),
    "mem16_write_back": lambda s, d: M.write_back(_results(s, d), allowed=("episode", "user-decision"), halt_on=("halt",)).select("id", "status", "reason", "halted"),
}

_E = f"WITH e AS ({S.ENTRIES_SQL}), r AS ({S.RELATIONS_SQL})"
_T = f"WITH t AS ({TRIPLES_SQL}), n AS (SELECT s node, string_agg(DISTINCT o, ',' ORDER BY o) types FROM t WHERE p = 'type' GROUP BY 1 HAVING NOT bool_or(o IN ('Rail', 'Stream')))"
_X = f"WITH x AS (SELECT *, CASE said WHEN 'user' THEN 'human' WHEN 'human' THEN 'human' WHEN 'system' THEN 'system' WHEN 'workflow' THEN 'workflow' WHEN 'model' THEN 'model' ELSE 'self' END subject FROM ({EXECUTIONS_SQL}))"
_XT = "SELECT node, workflow, 0.6::DOUBLE * CASE subject WHEN 'human' THEN 0.95 WHEN 'system' THEN 0.85 WHEN 'self' THEN 0.75 WHEN 'workflow' THEN 0.70 ELSE 0.65 END::DOUBLE + 0.4::DOUBLE * ((method IS NOT NULL)::INT + (policy IS NOT NULL)::INT + (timestamp IS NOT NULL)::INT) / 3 trust FROM x"
_OWN = """SELECT id, 0.4::DOUBLE * coalesce(greatest(0, least(1, CAST(confidence AS DOUBLE))), 0.5) + CASE WHEN validation IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * coalesce(greatest(0, least(1, CAST(coverage AS DOUBLE))), 0.5)
  + 0.2::DOUBLE * ((author IS NOT NULL)::INT + (version IS NOT NULL)::INT + (timestamp IS NOT NULL)::INT + (validation IS NOT NULL)::INT + (coverage IS NOT NULL)::INT + (confidence IS NOT NULL)::INT) / 6 trust FROM a"""
_WORDS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9_.-]{{3,}}'), lambda x: lower(x)))"
#: Every node and entry with the entry's score for it, -1 where its type is not allowed.
_SCORES = f"""{_E}, b AS (SELECT item_id node, {_WORDS.format("text")} words, [CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END, 'src' || (item_id % 20)] tags, item_id % 5 = 0 few FROM benchmark),
 d AS (SELECT *, {_WORDS.format("concat_ws(' ', id, type, text, lang)")} words, CASE type WHEN 'user-decision' THEN 24 WHEN 'episode' THEN 20 ELSE 0 END p FROM e),
 hits AS (SELECT node, id, count(*) n FROM (SELECT node, unnest(words) word FROM b) JOIN (SELECT id, unnest(words) word FROM d) USING (word) GROUP BY node, id),
 sc AS (SELECT node, id, created_at, text, CASE WHEN few AND type NOT IN ('user-decision', 'trouble') THEN -1 ELSE p + coalesce(n, 0) + CASE WHEN lang IN (tags[1], tags[2]) THEN 18 ELSE 0 END + CASE WHEN source IN (tags[1], tags[2]) THEN 12 ELSE 0 END END score
  FROM b CROSS JOIN d LEFT JOIN hits USING (node, id)),
 top AS (SELECT node, id, CAST(score AS BIGINT) score, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, created_at, id) rank FROM sc WHERE score >= 0) WHERE rank <= 5)"""
_CAMEL = "CASE kind WHEN 'references' THEN kind WHEN 'invalidated-by' THEN 'invalidatedBy' WHEN 'verified-in' THEN 'verifiedIn' WHEN 'rolls-back' THEN 'rollsBack' WHEN 'resolved-by' THEN 'resolvedBy' END"
_FULL = f"""WITH a AS ({S.ENTRIES_SQL}), e AS (SELECT CASE WHEN i % 13 = 5 THEN 'XX-' WHEN type = 'release-note' THEN 'RN-' WHEN type = 'trouble' THEN 'TS-' WHEN type = 'user-decision' THEN 'UD-' ELSE 'EP-' END || i AS id, CASE type WHEN 'trouble' THEN 'trouble-shooting' ELSE type END AS type, i, created_at, text, lang, source FROM a),
 r AS (SELECT e.id src, kind, CASE kind WHEN 'references' THEN 'doc-' || dst ELSE dst END AS dst FROM ({S.RELATIONS_SQL}) x JOIN e ON x.src = 'E-' || e.i),
 t AS (SELECT DISTINCT s, p, o FROM (SELECT id AS s, 'type' AS p, 'Entry' AS o FROM e UNION ALL SELECT id, 'entryId', id FROM e UNION ALL SELECT id, 'typeName', type FROM e UNION ALL SELECT id, 'createdAt', created_at FROM e UNION ALL SELECT id, 'text', text FROM e WHERE text <> ''
  UNION ALL SELECT id, 'tag', lang FROM e WHERE i % 3 > 0 UNION ALL SELECT id, 'tag', source FROM e WHERE i % 3 > 0 UNION ALL SELECT id, 'metadata', '{{"a":"' || i || '"' || coalesce(',"z":"' || source || '"', '') || '}}' FROM e WHERE i % 4 = 0
  UNION ALL SELECT id, 'metadataKey', unnest(['a', 'z']) FROM e WHERE i % 4 = 0 UNION ALL SELECT id, 'meta/a', CAST(i AS VARCHAR) FROM e WHERE i % 4 = 0 UNION ALL SELECT id, 'meta/z', source FROM e WHERE i % 4 = 0
  UNION ALL SELECT src, {_CAMEL}, CASE WHEN kind = 'references' THEN 'external:' || dst ELSE dst END FROM r UNION ALL SELECT 'external:' || dst, 'type', 'ExternalReference' FROM r WHERE kind = 'references' UNION ALL SELECT 'external:' || dst, 'externalValue', dst FROM r WHERE kind = 'references') WHERE o IS NOT NULL)"""
ORACLE_SQL = {
    "src6_scopes": "SELECT CASE event_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'audit' WHEN 2 THEN 'worklog' ELSE 'intent' END AS scope, count(*) records, count(*) FILTER (event_id % 97 = 0) bad FROM events GROUP BY 1",
    "src9_nodes": _T + " SELECT node, types FROM n",
    "src9_edges": _T + """, g AS (SELECT s edge, max(o) FILTER (p = 'type') AS class, min(o) FILTER (p = 'from') src, min(o) FILTER (p = 'to') dst, min(o) FILTER (p = 'streamType') kind, min(o) FILTER (p = 'criteria') criteria FROM t WHERE s LIKE 'edge/%' GROUP BY 1)
  SELECT * FROM g WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""",
    "flt7_values": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a' || event_id || ', b, c' WHEN 1 THEN '{"a":"x","z":' || event_id || '}' WHEN 2 THEN 't' || event_id WHEN 4 THEN CAST(event_id AS VARCHAR) END AS value FROM events""",
    "flt9_classes": "SELECT 'part/' || p_partkey node FROM part WHERE p_size % 2 <> 0 OR p_size % 3 = 0",
    "flt10_scopes": "SELECT l_returnflag AS scope, count(DISTINCT l_orderkey) names FROM lineitem GROUP BY 1",
    "flt12_refs": "SELECT DISTINCT 'doc-' || p_size || CASE p_size % 3 WHEN 0 THEN '.yaml' ELSE '.yml' END ref FROM part WHERE p_size % 3 < 2",
    "fn17_labels": "SELECT 'part/' || p_partkey node, CASE WHEN p_size % 5 <> 0 THEN coalesce(nullif(trim(replace(p_name, chr(10), ' ')), ''), CAST(p_partkey AS VARCHAR)) ELSE CAST(p_partkey AS VARCHAR) END AS label FROM part UNION ALL SELECT 'run/' || o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT DISTINCT 'edge/' || l_orderkey || '-' || l_linenumber, l_orderkey || '-' || l_linenumber FROM lineitem",
    "fn13_subjects": _X + " SELECT node, subject FROM x",
    "agg10_prefixes": "SELECT CASE WHEN event_id % 3 = 0 THEN 'TS' ELSE 'EP' END prefix, count(*) cnt FROM events WHERE event_id % 97 <> 0 GROUP BY 1",
    "agg19_status": "SELECT o_custkey workflow, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'O') THEN 'active' ELSE 'pending' END status FROM orders GROUP BY 1",
    "agg20_manifest": """SELECT 'run/' || o_orderkey node, o_orderpriority harness, CASE WHEN o_orderkey % 3 = 0 THEN 'warn' ELSE 'block' END on_fail, count(*) OVER (PARTITION BY o_orderpriority) shared FROM orders WHERE o_orderkey % 4 = 0""",
    "grf4_execution_trust": f"{_X} SELECT node, round(trust, 4) trust FROM ({_XT})",
    "grf5_full_trust": f"""{_X}, s AS ({S.STREAMS_SQL}), a AS ({S.ARTIFACTS_SQL}), m AS (SELECT DISTINCT o_orderpriority workflow, 'run/' || o_orderkey node FROM orders),
  c AS (SELECT workflow, avg(trust) v FROM s JOIN m ON dst = node JOIN ({_OWN}) o ON src = o.id WHERE kind = 'consumed_by' GROUP BY 1), w AS (SELECT workflow, avg(trust) v FROM ({_XT}) GROUP BY 1),
  p AS (SELECT workflow, avg(greatest(0, least(1, CAST(c_acctbal AS DOUBLE) / 10000))) v FROM s JOIN m ON src = node JOIN customer ON dst = 'customer/' || c_custkey WHERE kind = 'produces_to' GROUP BY 1)
  SELECT workflow, round(0.4::DOUBLE * c.v + 0.3::DOUBLE * w.v + 0.3::DOUBLE * p.v, 4) trust FROM c JOIN w USING (workflow) JOIN p USING (workflow)""",
    "grf16_without_method": _X + " SELECT node FROM x WHERE method IS NULL",
    "grf17_shapeless": "SELECT page_id id, 'path' AS missing FROM pages WHERE page_id % 3 = 0 OR trim(coalesce(url, '')) = '' UNION ALL SELECT page_id, 'role' FROM pages WHERE page_id % 4 = 0",
    "mem11_digest": f"""{_E}, v AS (SELECT src, dst, dst IN (SELECT dst FROM r WHERE kind = 'rolls-back') gone, row_number() OVER (PARTITION BY dst IN (SELECT dst FROM r WHERE kind = 'rolls-back') ORDER BY src, dst) n FROM r WHERE kind = 'invalidated-by'),
  c AS (SELECT id FROM e WHERE type = 'release-note' AND coalesce(note_kind, 'release') <> 'rollback' AND id NOT IN (SELECT dst FROM r WHERE kind = 'rolls-back') ORDER BY coalesce(released_at, created_at) DESC, id LIMIT 1)
  SELECT 'current' section, 1 AS position, (SELECT id FROM c) id, NULL::VARCHAR AS release UNION ALL SELECT 'invalidated', CAST(n AS INTEGER), src, dst FROM v WHERE NOT gone AND n <= 10
  UNION ALL SELECT 'more', CAST(count(*) - 10 AS INTEGER), NULL, NULL FROM v WHERE NOT gone HAVING count(*) > 10 UNION ALL SELECT 'candidate', CAST(n AS INTEGER), src, dst FROM v WHERE gone AND n <= 5""",
    "mem12_relevance": _SCORES + " SELECT node, id, score, rank FROM top",
    "mem13_context": _SCORES + """, k AS (SELECT r.src, r.dst FROM r JOIN e ON r.dst = e.id), both_ways AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k),
  p AS (SELECT node, id, 0 AS depth FROM top UNION ALL SELECT DISTINCT top.node, dst, 1 FROM top JOIN both_ways ON top.id = src WHERE NOT EXISTS (SELECT 1 FROM top q WHERE q.node = top.node AND q.id = dst))
  SELECT node, id, depth, CAST(score AS INTEGER) score, sha256(coalesce(substring(text, 1, 1200), '')) text_sha256 FROM p JOIN sc USING (node, id)""",
    "grf3_rounds": f"""WITH e AS ({DEEP_SQL}), a AS ({S.ARTIFACTS_SQL}), t0 AS ({_OWN})
 {"".join(f", m{i} AS (SELECT dst, avg(trust) m FROM e JOIN t{i - 1} ON src = id GROUP BY dst), t{i} AS (SELECT t0.id, CASE WHEN m IS NULL THEN t0.trust ELSE 0.7::DOUBLE * t0.trust + 0.3::DOUBLE * m END trust FROM t0 LEFT JOIN m{i} ON t0.id = dst)" for i in (1, 2, 3))}
 SELECT id, round(trust, 6) trust FROM t3""",
    "agg21_fingerprint": _E + """, b0 AS (SELECT sha256(id) AS k, id || ':' || sha256(CAST(to_json({'created_at': created_at, 'id': id, 'text': text, 'type': type}) AS VARCHAR)) AS h FROM e)"""
    + "".join(f", b{i} AS (SELECT k, k || ':' || sha256(string_agg(h, ',' ORDER BY h)) AS h FROM (SELECT substr(k, 1, {n}) AS k, h FROM b{i - 1}) GROUP BY k)" for i, n in ((1, 9), (2, 6), (3, 3), (4, 0))) + " SELECT substr(h, 2, 64) AS fingerprint FROM b4",
    "mem5_shapes": f"""WITH e AS ({_related_sql("list_extract([{}], {})".format)}), r AS (SELECT e.id src, e.type src_type, e.kind, e.dst, t.type dst_type, t.id IS NOT NULL known FROM e LEFT JOIN e t ON e.dst = t.id),
 s AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{','.join(f)}', '{','.join(t)}')" for k, f, t in M.SHAPES)}) v(kind, f, t)),
 x AS (SELECT r.*, f = '' OR list_contains(string_split(f, ','), src_type) meant, t FROM r JOIN s USING (kind))
 SELECT src, src_type, kind, dst, dst_type, 'target is no entry' AS issue FROM x WHERE meant AND NOT known UNION ALL SELECT src, src_type, kind, dst, dst_type, 'target type' FROM x WHERE meant AND known AND t <> '' AND NOT list_contains(string_split(t, ','), dst_type)
 UNION ALL SELECT src, src_type, kind, dst, dst_type, 'source type' FROM x WHERE kind = 'rolls-back' AND src_type <> 'release-note'""",
    "mem1_prefixes": _FULL + " SELECT id, 'id is not ' || CASE type WHEN 'release-note' THEN 'RN' WHEN 'trouble-shooting' THEN 'TS' WHEN 'user-decision' THEN 'UD' ELSE 'EP' END || ' of ' || type AS issue FROM e WHERE i % 13 = 5",
    "mem4_full": _FULL + " SELECT p, count(*) n, count(DISTINCT s) subjects, max(substring(o, 1, 40)) greatest FROM t GROUP BY p",
    "mem4_full_rows": _FULL + " SELECT * FROM t WHERE p <> 'text'",
    "flt13_legacy": "SELECT 'doc/' || o_orderkey path, 'legacy ' || CASE o_orderkey % 7 WHEN 0 THEN 'list of phases' ELSE 'named phases' END || ': move them to workflows' message FROM orders WHERE o_orderkey % 7 < 3",
    "fn15_json": """SELECT o_orderkey, '{"a":[{"b":"' || o_orderstatus || '","d":{"c":"x","y":1},"k":' || o_custkey || '}],"z":' || o_orderkey || '}' AS json FROM orders""",
    "mem14_similar": """WITH w AS (SELECT 0 side, item_id AS id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.-]{3,}')) t FROM benchmark UNION ALL SELECT 1, doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.-]{3,}')) FROM documents),
 n AS (SELECT side, id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 262144 b, count(*)::DOUBLE n FROM w GROUP BY ALL), d0 AS (SELECT count(*)::DOUBLE docs FROM documents), f AS (SELECT b, count(*) df FROM n WHERE side = 1 GROUP BY b),
 x AS (SELECT side, id, n.b, n * ln(1 + docs / coalesce(df, 1)) y FROM d0, n LEFT JOIN f ON n.b = f.b), v AS (SELECT side, id, b, y / sqrt(sum(y * y) OVER (PARTITION BY side, id)) x FROM x),
 m AS (SELECT q.id query, e.id, sum(q.x * e.x) score FROM v q JOIN v e USING (b) WHERE q.side = 0 AND e.side = 1 GROUP BY 1, 2),
 k AS (SELECT m.*, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, m.id) rank FROM m JOIN documents d ON m.id = d.doc_id WHERE query % 3 <> 0 OR lang = 'en' OR source = 'src' || (query % 20))
 SELECT query, id, round(score, 6) score, CAST(rank AS INTEGER) rank FROM k WHERE rank <= 5""",
    "mem15_follow_up": f"{_E} SELECT source AS module, max(created_at) FILTER (type = 'trouble') trouble_at, max(created_at) FILTER (type = 'episode') episode_at FROM e GROUP BY 1 HAVING trouble_at IS NOT NULL AND (episode_at IS NULL OR trouble_at > episode_at)",
    "mem16_write_back": f"""{_E} SELECT id, CASE WHEN i % 5 = 0 THEN NULL WHEN type = 'episode' THEN 'proposed' ELSE 'rejected' END status,
  CASE WHEN i % 5 = 0 OR type = 'episode' THEN NULL WHEN type = 'user-decision' THEN 'a user''s decision is not recorded by an execution' ELSE 'type not allowed' END reason, i % 4 = 0 halted FROM e""",
}
