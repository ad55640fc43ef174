"""What kind of thing an artifact is, who makes and who uses it, and where its supply chain breaks (FN-7, FN-9, AGG-15, AGG-16, GRF-20)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import CONSUMERS, NATIVE

#: Markers by what they tell of.
MARKERS = {
    "knowledge_store": ("ontology", "schema", "embedding", "api", "mcp", "graph", "rdf", "owl", "shacl", "ttl", "tbox", "abox", "workflow", "visual-dom", "catalog"),
    "event_store": ("work-memory", "work_memory", "auditlog", "audit-log", "worklog", "work-log", "event", "jsonl"),
    "local_database": ("database", "sqlite", "duckdb", "cache.db", ".db"),
    "media": (".html", ".pdf", ".pptx", ".png", ".svg", ".jpg", ".jpeg", ".gif", ".webp", ".mp4"),
    "tool": ("[[process]]", "[[tool]]", "engine process", "nlu engine process", "processing artifact", "tool use"),
}
TABLE_MARKERS = ("table:", "sqlite_table:", "db_table:")
REMOTE = ("api", "mcp", "object_store", "external_url")
TOOL_PATTERN = r"\[\[[^\]]*(process|tool|processing artifact)[^\]]*\]\]"
#: Type of an artifact by the first rule that holds: the type, the legacy kind that the rule is for (null: none given or another), data types, markers of these types in the text, and whether the text
#: must hold a hash sign or one of the names begin like a table.
RULES = [
    ("event_store", "data", None, "event_store", None),
    ("local_database", "data", None, "local_database", None),
    ("knowledge_store", "data", None, None, None),
    ("media", "file", None, "media", None),
    ("document", "file", None, None, None),
    ("local_database", None, ("database",), None, None),
    ("table", None, None, None, "table"),
    ("table", None, None, "local_database", "hash"),
    ("knowledge_store", None, REMOTE, None, None),
    ("local_database", None, None, "local_database", None),
    ("event_store", None, None, "event_store", None),
    ("knowledge_store", None, None, "knowledge_store", None),
    ("tool", None, None, "tool", None),
    ("media", None, None, "media", None),
    ("document", None, None, None, None),
]
FIELDS = ("artifact_id", "locator", "source", "role", "detail")


def _stripped(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def with_types(artifacts: DataFrame) -> DataFrame:
    """artifacts with artifact_type, resource_kind and primary_consumer (FN-7).

    Read are explicit_type, resource_kind, data_type and FIELDS, each of which may be null or absent: a valid explicit type stands; else the first of RULES holds. The kind then follows from the type.
    """
    col = lambda c: F.col(c) if c in artifacts.columns else F.lit(None).cast("string")
    given = {c: F.lower(F.coalesce(col(c).cast("string"), F.lit(""))) for c in FIELDS}
    work = {"_text": F.concat_ws(" ", *given.values()), "_explicit": _stripped(col("explicit_type")), "_kind": _stripped(col("resource_kind")), "_data": _stripped(F.coalesce(F.nullif(col("data_type"), F.lit("")), F.lit("local_file")))}
    found = {f"_is_{t}": reduce(or_, [F.contains(F.col("_text"), F.lit(m)) for m in marks]) for t, marks in MARKERS.items()}
    found["_is_tool"] |= F.col("_text").rlike(TOOL_PATTERN)
    found["_as_table"] = reduce(or_, [F.startswith(given[c], F.lit(m)) for c in ("locator", "artifact_id", "detail") for m in TABLE_MARKERS])
    out = F.when(F.col("_explicit").isin(*CONSUMERS), F.col("_explicit"))
    for name, kind, data, mark, form in RULES:
        tests = [F.col("_kind") == kind if kind else ~F.col("_kind").isin("data", "file")]
        tests += [F.col("_data").isin(*data)] if data else []
        tests += [F.col(f"_is_{mark}")] if mark else []
        tests += [F.col("_as_table")] if form == "table" else [F.contains(F.col("_text"), F.lit("#"))] if form == "hash" else []
        out = out.when(reduce(lambda a, b: a & b, tests), name)
    who = F.create_map(*[F.lit(x) for t, (w, _) in CONSUMERS.items() for x in (t, w)])
    typed = artifacts.withColumns(work).withColumns(found).withColumn("artifact_type", out).drop(*work, *found)
    return typed.withColumns({"resource_kind": F.when(F.col("artifact_type").isin(*NATIVE), "data").otherwise("file"), "primary_consumer": who[F.col("artifact_type")]})


def role_of(role: Column, mode: str = "report") -> tuple[Column, Column, Column]:
    """(produces, consumes, detail) of a role (FN-9). Mode ``upgrade``: staging and read do not consume, nor does a role that merely mentions a reference or an instruction.

    Plain roles have no detail.
    """
    r = F.replace(F.lower(role), F.lit("-"), F.lit("_"))
    produces = F.contains(r, F.lit("output")) | r.isin("staging", "generated", "write")
    if mode == "upgrade":
        consumes = F.contains(r, F.lit("input")) | r.isin("reference", "instruction")
    else:
        consumes = F.contains(r, F.lit("input")) | F.contains(r, F.lit("reference")) | F.contains(r, F.lit("instruction")) | r.isin("staging", "read")
    return produces, consumes, F.when(r.isin("output", "input", "reference", "input_output"), "").otherwise(F.trim(role))


def uses(directories: DataFrame, deliverables: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(scope, node, artifact, artifact_type, detail, produces, consumes) of the nodes of each scope (AGG-15).

    directories: node, path, role (null: reference), explicit_type; a role says who makes and who uses, folders of other roles are left out. deliverables: node, text; made by the node.
    edges: src, dst, kind; ``produces`` leads to an artifact, ``consumes``, ``check`` and ``measures`` from one. membership: scope, node.
    """
    makes, takes, _ = role_of(F.coalesce("role", F.lit("reference")))
    null = F.lit(None).cast("string")
    folders = directories.where("path <> ''").select("node", F.concat(F.lit("local_file:"), "path").alias("artifact"), F.col("path").alias("locator"), null.alias("detail"), "explicit_type", makes.alias("produces"), takes.alias("consumes"))
    given = deliverables.where("text <> ''").select("node", F.concat(F.lit("deliverable:"), "text").alias("artifact"), null.alias("locator"), F.col("text").alias("detail"), null.alias("explicit_type"), F.lit(True).alias("produces"), F.lit(False).alias("consumes"))
    made = edges.where("kind = 'produces'").select(F.col("src").alias("node"), F.col("dst").alias("a"), F.lit(True).alias("produces"), F.lit(False).alias("consumes"))
    used = edges.where("kind IN ('consumes', 'check', 'measures')").select(F.col("dst").alias("node"), F.col("src").alias("a"), F.lit(False).alias("produces"), F.lit(True).alias("consumes"))
    declared = made.unionByName(used).select("node", F.concat(F.lit("artifact:"), "a").alias("artifact"), null.alias("locator"), null.alias("detail"), null.alias("explicit_type"), "produces", "consumes")
    all_uses = folders.where("produces OR consumes").unionByName(given).unionByName(declared)
    typed = with_types(all_uses.withColumn("artifact_id", F.when(F.col("locator").isNull(), F.col("artifact"))))
    return typed.join(membership.select("scope", "node").hint("merge"), "node").select("scope", "node", "artifact", "artifact_type", F.coalesce("detail", "locator", F.lit("")).alias("detail"), "produces", "consumes")


def members(used: DataFrame) -> DataFrame:
    """(scope, artifact, node, produces, consumes): the producer and consumer sets of each artifact, a row for each member, as a set may be as large as the input (AGG-15).

    ``uses`` leaves its rows dealt by node, so that they are grouped where they are.
    """
    return used.groupBy("scope", "artifact", "node").agg(F.bool_or("produces").alias("produces"), F.bool_or("consumes").alias("consumes"))


def streams(used: DataFrame) -> DataFrame:
    """(scope, artifact, artifact_type, detail, producers, consumers): how many nodes make and use each; of several types or details the least."""
    once = used.groupBy("scope", "artifact", "node").agg(F.min("artifact_type").alias("artifact_type"), F.min("detail").alias("detail"), F.bool_or("produces").alias("p"), F.bool_or("consumes").alias("c"))
    return once.groupBy("scope", "artifact").agg(F.min("artifact_type").alias("artifact_type"), F.min("detail").alias("detail"), F.count_if("p").alias("producers"), F.count_if("c").alias("consumers"))


def gaps(used: DataFrame) -> DataFrame:
    """Artifacts of a scope that are produced but not consumed there, or the other way (AGG-16).

    scope, artifact, artifact_type, primary_consumer, detail, gap (unconsumed or external), nodes (how many make or use it; ``members`` names them), elsewhere (consumers in other scopes), hint, next_action.
    """
    everywhere = F.sum("consumers").over(Window.partitionBy("artifact"))
    open_ends = streams(used).withColumn("_all", everywhere).where("producers = 0 OR consumers = 0")
    gap = F.when(F.col("consumers") == 0, "unconsumed").otherwise("external")
    elsewhere = F.when(gap == "unconsumed", F.col("_all")).otherwise(0)
    t = F.col("artifact_type")
    # Hints and next actions.
    hint = F.when(gap == "external", F.concat(F.lit("external input ("), t, F.lit(")"))).when(elsewhere > 0, F.concat(F.lit("cross-workflow "), t, F.lit(" artifact")))
    hint = hint.when(t.isin(*NATIVE), F.concat(F.lit("missing agent consumer for "), t)).when(t == "media", "terminal media deliverable candidate").otherwise("terminal/review document candidate")
    action = F.when(gap == "external", None).when(elsewhere > 0, "link the downstream consumer workflow or split the artifact boundary intentionally")
    action = action.when(t.isin(*NATIVE), "add an agent consumer task, mark as external artifact output, or move it to a workflow that reads it")
    action = action.when(t == "media", "confirm a human review/delivery consumer exists, otherwise skip the artifact").otherwise("confirm agent/user consumer; else omit or convert to jsonl/ttl/sqlite")
    who = F.create_map(*[F.lit(x) for k, (w, _) in CONSUMERS.items() for x in (k, w)])
    return open_ends.select(
        "scope", "artifact", "artifact_type", who[t].alias("primary_consumer"), "detail", gap.alias("gap"), (F.col("producers") + F.col("consumers")).alias("nodes"), elsewhere.alias("elsewhere"),
        hint.alias("hint"), action.alias("next_action"),
    )


def gap_summary(found: DataFrame) -> DataFrame:
    """(measure, value, n): gaps by type, and the hints of what is unconsumed (AGG-16). Types without a gap count 0."""
    none = found.sparkSession.createDataFrame([(g, t, 0) for g in ("unconsumed", "external") for t in CONSUMERS], "measure string, value string, n long")
    n = found.groupBy("gap", "artifact_type", "hint").agg(F.count("*").alias("n"))
    row = lambda measure, value: F.struct(measure.alias("measure"), F.col(value).alias("value"))
    told = F.array_compact(F.array(row(F.col("gap"), "artifact_type"), F.when(F.col("gap") == "unconsumed", row(F.lit("hint"), "hint"))))
    return n.select(F.explode(told).alias("x"), "n").select("x.*", "n").unionByName(none).groupBy("measure", "value").agg(F.sum("n").alias("n"))


def artifact_index(artifacts: DataFrame) -> DataFrame:
    """(id, artifact_type, locator, provenance) of artifacts by id: declared values only, provenance in one line, each value cut to 24 characters (GRF-20)."""
    # Labels in the line.
    bits = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{label}: "), F.substring(F.col(c).cast("string"), 1, 24))) for c, label in (("author", "author"), ("version", "v"), ("confidence", "conf"), ("validation", "validated"), ("coverage", "cov"))]
    line = F.nullif(F.concat_ws(" · ", *bits), F.lit(""))
    return artifacts.select("id", F.coalesce(F.nullif("artifact_type", F.lit("")), F.lit("unspecified")).alias("artifact_type"), F.coalesce(F.nullif("locator", F.lit("")), F.lit("-")).alias("locator"), F.coalesce(line, F.lit("—")).alias("provenance"))
