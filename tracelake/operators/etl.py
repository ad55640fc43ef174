"""Documents and graphs from one form to another: flattening, upgrade and downgrade of edges, trees, drift, locators (ETL, JOIN-6)."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..tables import stored
from . import matching
from .graph import EDGE_CLASSES, display_id

DOCUMENT = (
    "project string, module string, workflows array<struct<id:string,nodes:array<struct<id:string,type:string,label:string,"
    "branches:array<struct<on:string,goto:string>>,directories:array<struct<path:string,role:string>>>>>>"
)
#: Edges of the edge model by the predicate that stands for them in the older model.
PREDICATES = {"next": "default", "consumes": "consumed_by", "produces": "produces_to", "measures": "measured_by", "target": "measures", "evolves": "evolves_to", "usesTool": "delegates_to"}
STREAMS = ("consumed_by", "produces_to")
#: Fixed value: hex digits of made ids, 128 bits. With 10 digits some of five million branches shared an id.
ID = 32


def flatten(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, directories) of JSON documents in a column ``value`` (ETL-1).

    nodes: id, type, label, workflow; edges: src, dst, on of branches, dst null where a branch leads nowhere, and of successors (on null) as TOP-5 has them: the next
    node in the document, not after a node with branches; directories: node, path, role. Ids are scoped by the module, else the workflow, else the project.
    """
    d = documents.select(F.from_json("value", DOCUMENT).alias("d")).where("d IS NOT NULL").select("d.project", "d.module", F.explode("d.workflows").alias("w"))
    scope = F.coalesce("module", "w.id", "project")
    n = d.select(F.concat(F.lit("workflow/"), scope, F.lit("/"), "w.id").alias("workflow"), scope.alias("scope"), F.posexplode("w.nodes").alias("at", "n"), F.col("w.nodes").alias("all"))
    named = lambda i: F.concat(F.lit("node/"), F.col("scope"), F.lit("/"), i)
    nodes = n.select(named(F.col("n.id")).alias("id"), F.col("n.type").alias("type"), F.coalesce("n.label", "n.id").alias("label"), "workflow")
    branches = n.select(named(F.col("n.id")).alias("src"), F.explode("n.branches").alias("b"), "scope").select("src", named(F.col("b.goto")).alias("dst"), F.col("b.on").alias("on"))
    after = F.get("all", F.col("at") + 1)["id"]
    nexts = n.where(after.isNotNull() & (F.coalesce(F.size("n.branches"), F.lit(0)) <= 0)).select(named(F.col("n.id")).alias("src"), named(after).alias("dst"), F.lit(None).cast("string").alias("on"))
    directories = n.select(named(F.col("n.id")).alias("node"), F.explode("n.directories").alias("x")).select("node", "x.path", "x.role")
    return nodes, branches.unionByName(nexts), directories


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (node, type, oracle_type, criteria, pass_criteria, branches) in the present form (ETL-2).

    A validation is an eval measured by a metric; its criteria come from pass_criteria, and a pass and a fail branch are added if there is none.
    """
    old = F.lower("type") == "validation"
    on = F.transform(F.coalesce("branches", F.array().cast("array<struct<on:string,goto:string>>")), lambda b: F.lower(b["on"]))
    branch = lambda name, *seen: F.when(~F.arrays_overlap(on, F.array(*map(F.lit, seen))) | (F.size(on) == 0), F.array(F.struct(F.lit(name).alias("on"), F.lit(None).cast("string").alias("goto")))).otherwise(F.array().cast("array<struct<on:string,goto:string>>"))
    full = F.concat(F.coalesce("branches", F.array().cast("array<struct<on:string,goto:string>>")), branch("passed", "pass", "passed"), branch("failed", "fail", "failed"))
    criteria = F.when(F.coalesce(F.size("criteria"), F.lit(0)) > 0, F.col("criteria")).otherwise(F.col("pass_criteria"))
    return nodes.select(
        "node", F.when(old, "eval").otherwise(F.col("type")).alias("type"), F.when(old, F.coalesce("oracle_type", F.lit("metric"))).otherwise(F.col("oracle_type")).alias("oracle_type"),
        F.when(old, criteria).otherwise(F.col("criteria")).alias("criteria"), F.when(old, full).otherwise(F.col("branches")).alias("branches"),
    )


def upgrade(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings) of triples of the older model (s, p, o): reified edges (edge, class, src, dst, kind, on, criteria) by a stable id (ETL-3).

    A branch whose goto is no known subject leads to the end of the source's scope, with a warning (src, goto). A tool becomes a delegated execution named by its text.
    """
    known = triples.select(F.col("s").alias("node")).distinct()
    kind = F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair])[F.col("p")]
    none = F.lit(None).cast("string")
    tool = F.concat(F.lit("tool/"), fn.short_id(F.col("o"), ID))
    plain = triples.where(F.col("p").isin(*PREDICATES)).select(F.col("s").alias("src"), F.when(F.col("p") == "usesTool", tool).otherwise(F.col("o")).alias("dst"), kind.alias("kind"), none.alias("on"), none.alias("criteria"))
    of = triples.where("p IN ('on', 'criteria', 'gotoNode')").groupBy(F.col("s").alias("branch")).agg(*[F.min(F.when(F.col("p") == c, F.col("o"))).alias(c) for c in ("on", "criteria", "gotoNode")])
    owned = triples.where("p = 'hasBranch'").select(F.col("s").alias("src"), F.col("o").alias("branch")).join(of, "branch").where("on IS NOT NULL")
    met = owned.join(known.withColumn("known", F.lit(True)), owned["gotoNode"] == known["node"], "left")
    lost = F.col("gotoNode").isNotNull() & F.col("known").isNull()
    end = F.concat(F.lit("end/"), fn.short_id(F.col("src"), ID))
    branches = met.select("src", F.when(F.col("known"), F.col("gotoNode")).otherwise(end).alias("dst"), F.lit("default").alias("kind"), "on", "criteria")
    edges = plain.unionByName(branches).distinct()
    ident = F.concat(F.lit("edge/"), fn.short_id(F.concat_ws("|", "src", "kind", "dst", F.coalesce("on", F.lit(""))), ID))
    class_ = F.when(F.col("kind").isin(*STREAMS), EDGE_CLASSES[1]).otherwise(EDGE_CLASSES[0])
    return edges.select(ident.alias("edge"), class_.alias("class"), "src", "dst", "kind", "on", "criteria"), met.where(lost).select("src", F.col("gotoNode").alias("goto"))


def downgrade(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(s, p, o): what edges of the edge model and the classes of nodes (node, class, subject) are in the older model (ETL-4).

    Control edges from a start are left out, and those to an end unless they are branches, which then lead nowhere. A branch is named by its edge.
    """
    a, b = (classes.select(F.col("node").alias(end), F.col("class").alias(f"_{end}")) for end in ("src", "dst"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    row = lambda s, p, o: F.struct(F.col(s).alias("s") if isinstance(s, str) else s.alias("s"), F.lit(p).alias("p"), (F.col(o) if isinstance(o, str) else o).alias("o"))
    kind, to_end = F.col("kind"), F.coalesce(F.col("_dst") == "End", F.lit(False))
    flow = (kind == "default") & F.coalesce(F.col("_src") != "Start", F.lit(True))
    branch = flow & F.col("on").isNotNull()
    at = F.concat(F.lit("branch/"), fn.short_id(F.col("edge"), ID))
    made = [
        F.when(branch, row("src", "hasBranch", at)), F.when(branch, row(at, "type", F.lit("Branch"))), F.when(branch, row(at, "on", "on")), F.when(branch & F.col("criteria").isNotNull(), row(at, "criteria", "criteria")),
        F.when(branch & ~to_end, row(at, "gotoNode", "dst")), F.when(branch & ~to_end, row(at, "goto", display_id(F.col("dst")))),
        F.when(flow & F.col("on").isNull() & ~to_end | (kind == "escalates_to"), row("src", "next", "dst")),
        F.when(kind.isin("reads", "consumed_by"), row("src", "consumes", "dst")), F.when(kind == "produces_to", row("src", "produces", "dst")),
        F.when(kind == "delegates_to", row("src", "usesTool", F.concat(F.lit("[["), display_id(F.col("dst")), F.lit("]]")))), F.when(kind == "measured_by", row("src", "measures", "dst")), F.when(kind == "measures", row("src", "target", "dst")),
        F.when(kind.isin("evolves_to", "tests_to") & F.coalesce(F.col("_dst") != "Artifact", F.lit(True)), row("src", "evolves", "dst")),
    ]
    of_edges = e.select(F.explode(F.array_compact(F.array(*made))).alias("r")).select("r.*")
    run = classes.where(~F.col("class").isin("Start", "End", "Artifact"))
    who = F.when(F.col("subject") == "human", "user").when((F.col("subject") == "system") & (F.col("class") == "Eval"), "metric").otherwise("agent")
    plain = ~F.col("class").isin("Eval", "Decision")
    of_nodes = [row("node", "type", F.lit("Node")), F.when(F.col("class") == "Eval", row("node", "oracleType", who)), F.when(F.col("class") == "Decision", row("node", "decisionSubject", who)), F.when(plain, row("node", "type", F.lit("Step"))), F.when(plain, row("node", "type", F.lit("Task")))]
    return of_edges.unionByName(run.select(F.explode(F.array_compact(F.array(*of_nodes))).alias("r")).select("r.*")).distinct()


def model_of(triples: DataFrame) -> DataFrame:
    """(file, edge_model): whether a file's graph holds any rail, stream or execution (ETL-7)."""
    return triples.groupBy("file").agg(F.bool_or((F.col("p") == "type") & F.col("o").isin("Rail", "Stream", "Execution")).alias("edge_model"))


def drift(expected: DataFrame, present: DataFrame, *, key: str | list[str]) -> DataFrame:
    """(key, state): rows that are missing, extra or changed against what is expected (ETL-6). Columns are compared by name; the columns of the key tell one row."""
    key = [key] if isinstance(key, str) else key
    same = sorted(expected.columns)
    told = lambda df, name: df.select(*key, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in same]).alias(name))
    met = told(expected, "_a").join(told(present.select(*expected.columns), "_b"), key, "full")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return met.select(*key, state.alias("state")).where("state IS NOT NULL")


def resolve_tree(roots: DataFrame, references: DataFrame, known: DataFrame, *, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents (root, doc, depth), issues (root, doc, issue)) of following references (doc, sub) from roots (doc) (ETL-5).

    Each document is taken once for a root, at its least depth. A reference to an unknown document is missing, one to a document above is a cycle, one from the last level is too deep.
    """
    front = roots.select(F.col("doc").alias("root"), "doc", F.array("doc").alias("path"))
    seen, issues = front.select("root", "doc", F.lit(0).alias("depth")), None
    here = known.select(F.col("doc").alias("sub"), F.lit(True).alias("_known"))
    for d in range(1, depth + 2):
        step = stored(front.join(references, "doc").join(here, "sub", "left").select("root", "sub", "path", "_known"))
        issue = F.when(F.col("_known").isNull(), "missing").when(F.array_contains("path", F.col("sub")), "cycle").when(F.lit(d > depth), "depth")
        found = step.select("root", F.col("sub").alias("doc"), issue.alias("issue")).where("issue IS NOT NULL").distinct()
        issues = found if issues is None else issues.unionByName(found)
        if d > depth:
            break
        fresh = step.where(F.col("_known") & ~F.array_contains("path", F.col("sub"))).groupBy("root", F.col("sub").alias("doc")).agg(F.min("path").alias("path")).join(seen, ["root", "doc"], "left_anti")
        front = fresh.withColumn("path", F.concat("path", F.array("doc")))
        seen = seen.unionByName(front.select("root", "doc", F.lit(d).alias("depth")))
    return seen, issues.distinct()


def resolve_locators(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """queries (locator, data_type) with id and step: the registry (id, locator) by four ranked steps (JOIN-6).

    exact; a table stops here; the longest registered directory above the locator; the longest registered locator that ends with it; else data_type:locator.
    Equal lengths go to the smaller id. Paths above and endings are exploded, so every step is a join by equality.
    """
    q = queries.select("data_type", fn.locator(F.col("locator")).alias("locator")).distinct()
    r = registry.select("id", fn.locator(F.col("locator")).alias("r")).where("r <> ''")
    best = lambda df: df.groupBy("data_type", "locator").agg(F.min(F.struct((-F.length("r")).alias("n"), "id")).alias("b")).select("data_type", "locator", "b.id")
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    exact = best(q.join(r.select("id", "r", bare(F.col("r")).alias("k")), bare(F.col("locator")) == F.col("k")))
    parts = F.split("locator", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(F.split(F.col("locator"), "/"), 1, n), "/"))
    nested = q.where(F.contains("locator", F.lit("/"))).withColumn("k", F.explode(above))
    prefix = best(nested.join(r.select("id", "r", bare(F.col("r")).alias("k")), "k"))
    ends = r.select("id", "r", F.explode(F.transform(F.sequence(F.lit(2), F.length("r")), lambda n: F.substr(F.col("r"), n))).alias("k")).where("k <> ''")
    suffix = best(q.join(ends, q["locator"] == ends["k"]))
    out = q
    for name, found in (("exact", exact), ("prefix", prefix), ("suffix", suffix)):
        out = out.join(found.withColumnRenamed("id", name), ["data_type", "locator"], "left")
    free = F.col("data_type") != "table"
    step = F.when(F.col("exact").isNotNull(), "exact").when(free & F.col("prefix").isNotNull(), "prefix").when(free & F.col("suffix").isNotNull(), "suffix").otherwise("none")
    ident = F.coalesce("exact", F.when(free, F.coalesce("prefix", "suffix")), F.concat_ws(":", "data_type", "locator"))
    return out.select("data_type", "locator", ident.alias("id"), step.alias("step"))


def execution_edges(nodes: DataFrame, depends: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, kind), warnings (node, goto)) of nodes (node, phase), depends (node, on_node), branches (node, goto) (GRF-22).

    What a node depends on leads to it; a phase leads to its first node by name; each node to the next by name in its phase, unless it has branches; branches to their known targets.
    """
    known = nodes.select("node").distinct()
    has = lambda df, c: df.join(known.withColumnRenamed("node", c), c, "left_semi")
    needs = has(has(depends, "on_node"), "node").select(F.col("on_node").alias("src"), F.col("node").alias("dst"), F.lit("depends_on").alias("kind"))
    own = nodes.where("phase IS NOT NULL")
    entry = own.groupBy("phase").agg(F.min("node").alias("dst")).select(F.col("phase").alias("src"), "dst", F.lit("phase_entry").alias("kind"))
    after = own.withColumn("dst", F.lead("node").over(Window.partitionBy("phase").orderBy("node"))).where("dst IS NOT NULL").join(branches.select("node").distinct(), "node", "left_anti")
    goes = branches.where("goto IS NOT NULL")
    taken = has(goes, "goto")
    edges = needs.unionByName(entry).unionByName(after.select(F.col("node").alias("src"), "dst", F.lit("lexical_next").alias("kind"))).unionByName(taken.select(F.col("node").alias("src"), F.col("goto").alias("dst"), F.lit("branch").alias("kind")))
    return edges, goes.join(known.withColumnRenamed("node", "goto"), "goto", "left_anti").select("node", "goto")


INDEX = (
    "data_registry array<struct<id:string,data_type:string,type:string,locator:string,location:string,path:string,endpoint:string,resource:string,role:string>>,"
    "modules array<struct<id:string,path:string,status:string,data_type:string,role:string,subdirs:array<struct<id:string,path:string,data_type:string,role:string>>>>"
)


def registry_rows(documents: DataFrame) -> DataFrame:
    """(id, data_type, locator, source, role) of index documents in a column ``value``: registered data, active modules and their folders (SRC-7).

    The first of locator, location, path, endpoint and resource counts; a folder without an id is named by its module and path; rows without an id or a locator are left out.
    """
    d = documents.select(F.from_json("value", INDEX).alias("d")).where("d IS NOT NULL")
    given = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    kind = lambda *cs: F.coalesce(given(*cs), F.lit("local_file"))
    row = lambda df, i, t, where, source, role: df.select(i.alias("id"), t.alias("data_type"), fn.locator(where).alias("locator"), F.lit(source).alias("source"), F.coalesce(F.trim(role), F.lit("")).alias("role"))
    data = d.select(F.explode("d.data_registry").alias("x"))
    out = row(data, given("x.id"), kind("x.data_type", "x.type"), given("x.locator", "x.location", "x.path", "x.endpoint", "x.resource"), "data_registry", F.col("x.role"))
    m = d.select(F.explode("d.modules").alias("m")).where(F.lower(F.coalesce(given("m.status"), F.lit("active"))) == "active")
    out = out.unionByName(row(m, given("m.id"), kind("m.data_type"), F.trim("m.path"), "module", F.col("m.role")))
    s = m.select("m.id", "m.path", F.explode("m.subdirs").alias("s"))
    slug = F.replace(F.regexp_replace(fn.locator(F.col("s.path")), "^/+|/+$", ""), F.lit("/"), F.lit("."))
    made = F.when(slug == "", F.col("id")).otherwise(F.concat_ws(".", "id", slug))
    out = out.unionByName(row(s, F.coalesce(given("s.id"), made), kind("s.data_type"), F.concat(F.trim("path"), F.trim("s.path")), "subdir", F.col("s.role")))
    return out.where("id <> '' AND locator <> ''")


#: Where a row comes from, first registered first.
SOURCES = ("data_registry", "module", "subdir")


def registry_lookup(rows: DataFrame, *order: str) -> DataFrame:
    """(key, id, data_type, locator, source) of registry rows: each locator with and without its last slash, a key for the row that was registered first (SRC-7).

    Rows stand by source, then by ``order``, then by id.
    """
    at = F.col("locator")
    keys = F.array_distinct(F.filter(F.array(at, F.when(at.endswith("/"), F.regexp_replace(at, "/+$", "")).otherwise(F.concat(at, F.lit("/")))), lambda k: k != ""))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), *order, "id"))
    named = rows.withColumn("key", F.explode(keys)).withColumn("_n", first)
    return named.where("_n = 1").select("key", "id", "data_type", "locator", "source")


def typed_entries(entries: DataFrame) -> DataFrame:
    """Entries with an id and a type, of their relations those with a type and a target (SRC-10)."""
    kept = F.filter(F.coalesce("relations", F.array().cast(entries.schema["relations"].dataType)), lambda r: r["type"].isNotNull() & r["target"].isNotNull())
    return entries.where("id <> '' AND type <> ''").withColumn("relations", kept)


def sorted_json(values: Column) -> Column:
    """A map, struct or array as JSON with the keys of every depth in order (FN-15). A VARIANT keeps its keys so; null fields of a struct are left out."""
    return F.to_json(F.parse_json(F.to_json(values)))


#: Keys of a document that name no phase.
RESERVED = (
    "meta", "metadata", "module", "project", "workflow", "dependencies", "key_decisions", "deliverables", "quality_metrics", "timeline", "versioning", "governance", "metrics", "milestones",
    "critical_dependencies", "feedback_loops", "success_criteria",
)


def legacy_inputs(documents: DataFrame) -> DataFrame:
    """(path, message) of JSON documents in ``value`` that still carry phases: a list ``phases``, else maps under names of their own, which are not reserved and don't begin with x_ or x- (FLT-13)."""
    rows = documents.select("path", F.try_parse_json("value").alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    keys = rows.sparkSession.sql("SELECT t.path, x.key, x.value FROM {t} t, LATERAL variant_explode(t.v) x", t=rows)
    kind = F.schema_of_variant("value")
    listed = (F.col("key") == "phases") & F.startswith(kind, F.lit("ARRAY"))
    named = ~F.col("key").isin(*RESERVED) & ~F.col("key").rlike("^x[_-]") & F.startswith(kind, F.lit("OBJECT"))
    found = keys.groupBy("path").agg(F.bool_or(listed).alias("a"), F.bool_or(named).alias("b"))
    how = F.when(F.col("a"), "list of phases").when(F.col("b"), "named phases")
    return found.select("path", F.concat(F.lit("legacy "), how, F.lit(": move them to workflows")).alias("message")).where("message IS NOT NULL")


def _bucket_counts(texts: DataFrame, key: str, dimensions: int) -> DataFrame:
    """(key, t, n): the buckets of each text's words, each once, and how many words fall into them; the two arrays are in step. A word's hash is worked out once by task, not once by use."""

    def count(batches):
        of: dict[str, int] = {}
        find = re.compile(r"[a-z0-9_.-]{3,}").findall
        for batch in batches:
            t, n, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                held: dict[int, int] = {}
                for w in find(text):
                    b = of.get(w)
                    if b is None:
                        if len(of) >= 1 << 18:
                            of.clear()
                        b = of[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions
                    held[b] = held.get(b, 0) + 1
                t.extend(held)
                n.extend(held.values())
                ends.append(len(t))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (t, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "t", "n"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(F.lower("text"), F.lit("")).alias("text")).mapInArrow(count, f"{key} {kind}, t array<int>, n array<int>")


def similar(queries: DataFrame, entries: DataFrame, *, k: int = 5, dimensions: int = 1 << 18) -> DataFrame:
    """(query, id, score, rank): the k entries whose words are most like each query's, by the cosine of hashed word counts, each weighted by ln(1 + entries / entries with that bucket) (MEM-14).
    Scores that agree to nine digits are alike; the smaller id is first.

    queries (query, tags, text), entries (id, tags, text), each id once; with tags only entries that share one are looked at. Words are counted once by entry; the weights of buckets, of which there are at most
    ``dimensions``, are broadcast. Norms are a number by entry, so its words are shuffled once, to meet the queries (see matching.top_k). A text without words has no like, nor does any match score 0.
    """
    many = entries.count()
    own = stored(_bucket_counts(entries, "id", dimensions)).select("id", F.inline(F.arrays_zip("t", "n")))
    rare = stored(own.groupBy("t").agg(F.log(1 + many / F.count("*")).alias("idf")))
    told = own.join(F.broadcast(rare), "t").select("id", "t", (F.col("n") * F.col("idf")).alias("w"))
    norm = lambda df, key: df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = _bucket_counts(queries, "query", dimensions).select("query", F.inline(F.arrays_zip("t", "n"))).join(F.broadcast(rare), "t", "left")
    asked = asked.select("query", "t", (F.col("n") * F.coalesce("idf", F.lit(math.log(1 + many)))).alias("w"))
    known = stored(entries.join(norm(told, "id"), "id", "left").select("id", F.lit(0.0).alias("worth"), F.col("tags").alias("_e"), "norm"))
    shared = F.when(F.coalesce(F.size("_q"), F.lit(0)) <= 0, True).otherwise(F.coalesce(F.arrays_overlap("_q", "_e"), F.lit(False)))
    top = matching.top_k(
        asked.join(norm(asked, "query"), "query").select("query", "t", (F.col("w") / F.col("norm")).alias("w")), told, known, queries.select("query", F.col("tags").alias("_q")),
        k=k, order=[F.col("score").desc(), F.col("id")], met=shared, scale=F.coalesce(1 / F.col("norm"), F.lit(1.0)), digits=9,
    )
    return top.where("exact > 0").select("query", "id", F.col("exact").alias("score"), "rank")
