"""Workflow documents of any depth as tables: groups in groups, workflows in workflows, and the fields that have no columns of their own (ETL-1, TOP-5).

A document stays a VARIANT; each round explodes the lists one level down, with the place in the document as an array of positions. There are as many rounds as the deepest document has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Keys that are no plain fields of a node.
STRUCTURE = ("type", "id", "steps", "nodes", "branches", "directories", "workflows", "target", "target_workflow", "evolves", "evolves_workflow")
#: Types of nodes that go on by their branches alone.
JUDGES = ("eval", "oracle", "validation")


def _text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def _items(rows: DataFrame, *lists: str) -> DataFrame:
    """The items of the first of the lists that a row's ``v`` has, one row each, with their position added to ``place``. Only an object has the fields that callers then ask for."""
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{x}", "variant") for x in lists])
    # An object has keys where a list has none, so that no schema of all that is below need be made.
    found = rows.sparkSession.sql("SELECT t.*, x.pos, x.value FROM {t} t, LATERAL variant_explode(t._inner) x WHERE x.key IS NULL", t=rows.withColumn("_inner", inner))
    return found.withColumn("place", F.concat("place", F.array("pos"))).drop("_inner", "pos")


def walk(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workflows (doc, workflow, parent, scope, place, v), nodes (doc, workflow, scope, id, parent, type, place, v)) of documents (doc, value) in JSON.

    A workflow stands in ``workflows`` of the document or of a workflow; a node in ``nodes`` or ``steps`` of a workflow or of a node. Ids are scoped by the module, else the outermost workflow, else the
    project. What is no object or has no id is left out with all below it; a text that is no JSON gives nothing.
    """
    d = documents.select("doc", F.try_parse_json("value").alias("v"), F.array().cast("array<int>").alias("place")).where("v IS NOT NULL")
    named = d.select("doc", "v", "place", _text(F.col("v"), "$.module").alias("module"), _text(F.col("v"), "$.project").alias("project"), F.lit(None).cast("string").alias("outer"), F.lit(None).cast("string").alias("parent"))
    front, workflows = named, None
    while True:
        found = _items(front, "workflows").withColumn("id", _text(F.col("value"), "$.id")).where("id <> ''").withColumn("outer", F.coalesce("outer", "id"))
        scope = F.coalesce("module", "outer", "project")
        level = stored(found.select("doc", F.concat(F.lit("workflow/"), scope, F.lit("/"), "id").alias("workflow"), "parent", scope.alias("scope"), "place", F.col("value").alias("v"), "module", "project", "outer"))
        if level.isEmpty() and workflows is not None:
            break
        workflows = level if workflows is None else workflows.unionByName(level)
        if level.isEmpty():
            break
        front = level.select("doc", "v", "place", "module", "project", "outer", F.col("workflow").alias("parent"))
    workflows = workflows.drop("module", "project", "outer")
    front, nodes = workflows.select("doc", "workflow", "scope", "v", "place", F.lit(None).cast("string").alias("parent")), None
    while True:
        found = _items(front, "nodes", "steps").withColumn("name", _text(F.col("value"), "$.id")).where("name <> ''")
        ident = F.concat(F.lit("node/"), "scope", F.lit("/"), "name")
        level = stored(found.select("doc", "workflow", "scope", ident.alias("id"), "parent", _text(F.col("value"), "$.type").alias("type"), "place", F.col("value").alias("v")))
        if level.isEmpty() and nodes is not None:
            return workflows, nodes
        nodes = level if nodes is None else nodes.unionByName(level)
        if level.isEmpty():
            return workflows, nodes
        front = level.select("doc", "workflow", "scope", "v", "place", F.col("id").alias("parent"))


def branches(nodes: DataFrame) -> DataFrame:
    """(src, on, dst, label): branches with an ``on``; dst is null where one leads nowhere."""
    b = _items(nodes.select("id", "scope", "v", "place"), "branches")
    goto = F.nullif(_text(F.col("value"), "$.goto"), F.lit(""))
    return b.select(F.col("id").alias("src"), _text(F.col("value"), "$.on").alias("on"), F.concat(F.lit("node/"), "scope", F.lit("/"), goto).alias("dst"), _text(F.col("value"), "$.label").alias("label")).where("on IS NOT NULL")


def nexts(nodes: DataFrame) -> DataFrame:
    """(src, dst): each node's next in the document, groups before what they hold (TOP-5). None follows a judge with branches, nor a decision of which a branch already leads there."""
    after = F.lead("id").over(Window.partitionBy("doc", "workflow").orderBy("place"))
    has = F.exists(F.try_variant_get("v", "$.branches", "array<variant>"), lambda b: ~F.is_variant_null(b))  # a list without anything is none
    row = nodes.select(F.col("id").alias("src"), after.alias("dst"), F.lower("type").alias("type"), F.coalesce(has, F.lit(False)).alias("has")).where("dst IS NOT NULL")
    kept = row.where(~(F.coalesce(F.col("type").isin(*JUDGES), F.lit(False)) & F.col("has")))
    taken = branches(nodes.where("lower(type) = 'decision'")).select("src", "dst").distinct()
    return kept.select("src", "dst").join(taken, ["src", "dst"], "left_anti")


def fields(nodes: DataFrame) -> DataFrame:
    """(id, field, value): all other fields of nodes. A list of plain values gives a row for each, a list or map of others, such as a narrative block, its JSON with sorted keys."""
    all_ = nodes.sparkSession.sql("SELECT t.id, x.key AS field, x.value AS v FROM {t} t, LATERAL variant_explode(t.v) x", t=nodes.select("id", "v")).where(~F.col("field").isin(*STRUCTURE))
    kind = F.schema_of_variant("v")
    plain_list = kind.rlike("^ARRAY<[A-Z]+([(][0-9, ]*[)])?>$") & (kind != "ARRAY<VOID>") & (kind != "ARRAY<VARIANT>")
    listed = nodes.sparkSession.sql("SELECT t.id, t.field, x.value AS v FROM {t} t, LATERAL variant_explode(t.v) x", t=all_.where(plain_list))
    single = all_.where(~plain_list & (kind != "VOID"))
    scalar = ~F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)")
    told = F.when(scalar, F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    return listed.unionByName(single).select("id", "field", told.alias("value"))


def directories(nodes: DataFrame) -> DataFrame:
    """(node, path, role, note)."""
    x = _items(nodes.select("id", "v", "place"), "directories")
    got = lambda *keys: F.coalesce(*[_text(F.col("value"), f"$.{k}") for k in keys])
    return x.select(F.col("id").alias("node"), got("path").alias("path"), got("role").alias("role"), got("note", "dir_note").alias("note")).where("path <> ''")
