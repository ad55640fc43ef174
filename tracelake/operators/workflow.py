"""Workflows as tables: their nodes with all properties, an order for graphs with cycles, entries and exits (GRF-23, TOP-7, GRF-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .graph import levels, strong_sets

#: Classes of nodes and their types; of several the last counts.
TYPES = {"Phase": "phase", "Step": "step", "Decision": "decision", "Validation": "validation", "Group": "group"}
SINGLE = ("label", "status", "instruction", "judge", "harness")


def safe_id(value: Column) -> Column:
    """Runs of other characters than letters, digits, dot, dash and underscore become one underscore; none at the ends; ``workflow`` if nothing is left (FN-11)."""
    text = F.regexp_replace(F.regexp_replace(F.trim(value), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "workflow").otherwise(text)


def local_id(value: Column) -> Column:
    return safe_id(F.regexp_extract(value, "[^#/]*$", 0))


def node_table(triples: DataFrame, routes: DataFrame, defaults: DataFrame, *, fallback: str = "local-ollama") -> DataFrame:
    """The nodes of triples (s, p, o): uri, id, type, label, status, instruction, judge, harness, pass_criteria (sorted array), provider, phase_id, branches (sorted array of struct(on, goto, label)) (GRF-23).

    Each kind of triple is grouped once under its own key: properties by node, names and targets by branch, phases by the node that they own, so no row holds all nodes of a phase. Of several values of a
    property the least counts. A label that is missing is the id. A phase has label and status only. Branches need ``on``; their label is it where none is given. routes (judge, provider) are those of
    decisions, defaults (type, provider) those of the others; both are policies of a few rows. Of several phases the greatest owns a node.
    """
    of = lambda *names: triples.where(F.col("p").isin(*names))
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o"))).alias(p)
    rank = F.max(F.when(F.col("p") == "type", F.array_position(F.array(*map(F.lit, TYPES)), F.col("o")))).alias("_rank")
    criteria = F.array_sort(F.collect_set(F.when(F.col("p") == "passCriteria", F.col("o")))).alias("pass_criteria")
    nodes = of("type", *SINGLE, "passCriteria").groupBy("s").agg(rank, *map(one, SINGLE), criteria).where("_rank > 0").withColumn("type", F.element_at(F.array(*map(F.lit, TYPES.values())), F.col("_rank").cast("int")))
    phases = stored(of("type").groupBy("s").agg(rank).where("_rank = 1").select("s"))
    owned = of("hasNode").join(phases, "s", "left_semi").select(F.col("o").alias("s"), local_id(F.col("s")).alias("phase_id")).groupBy("s").agg(F.max("phase_id").alias("phase_id"))
    told = of("on", "goto", "label").groupBy(F.col("s").alias("_b")).agg(*map(one, ("on", "goto", "label"))).where("on <> ''")
    goto = F.when(F.coalesce("goto", F.lit("")) != "", safe_id(F.col("goto"))).otherwise("").alias("goto")
    told = told.select("_b", F.col("on"), goto, F.coalesce(F.nullif("label", F.lit("")), "on").alias("label"))
    met = of("hasBranch").select("s", F.col("o").alias("_b")).join(told, "_b").groupBy("s").agg(F.array_sort(F.collect_set(F.struct("on", "goto", "label", "_b"))).alias("_all"))
    branches = met.select("s", F.transform("_all", lambda x: F.struct(x["on"].alias("on"), x["goto"].alias("goto"), x["label"].alias("label"))).alias("branches"))
    met = nodes.join(owned, "s", "left").join(branches, "s", "left")
    met = met.join(routes.select("judge", F.lit("decision").alias("type"), F.col("provider").alias("_own")), ["type", "judge"], "left").join(defaults.select("type", F.col("provider").alias("_default")), "type", "left")
    inner = F.col("type") != "phase"
    provider = F.coalesce(F.when(F.col("type") == "decision", F.col("_own")).otherwise(F.col("_default")), F.lit(fallback))
    ident = local_id(F.col("s"))
    return met.select(
        F.col("s").alias("uri"), ident.alias("id"), "type", F.coalesce(F.nullif("label", F.lit("")), ident).alias("label"), "status", *[F.when(inner, F.col(c)).alias(c) for c in ("instruction", "judge", "harness")],
        F.when(inner, F.col("pass_criteria")).otherwise(F.array().cast("array<string>")).alias("pass_criteria"), provider.alias("provider"), "phase_id",
        F.coalesce(F.when(inner, F.col("branches")), F.array().cast(branches.schema["branches"].dataType)).alias("branches"),
    )


def condensed_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level): an order of any graph by level, component, node (TOP-7).

    A strongly connected set stands as one super-node, named by its least node, at the level that it has in the graph of these; a node on no cycle is its own component. Edges
    to or from others than ``nodes`` don't count.
    """
    own = nodes.select("node").distinct()
    kept = edges.select("src", "dst").join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").where("src <> dst").distinct()
    sets = strong_sets(kept)
    placed = own.join(sets, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    ends = [placed.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst")]
    between = kept.join(ends[0], "src").join(ends[1], "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    return placed.join(levels(between).withColumnRenamed("node", "component"), "component", "left").select("node", "component", F.coalesce("level", F.lit(0)).alias("level"))


def compiled_order(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow, node, cyclic, level): the order of each workflow's nodes by level, then node; a workflow with a cycle is in the order of its nodes' names, all at level 0 (TOP-7)."""
    placed = condensed_order(membership, edges)
    several = placed.groupBy("component").agg((F.count("*") > 1).alias("_many"))
    met = membership.select("workflow", "node").join(placed, "node").join(several, "component")
    cyclic = met.groupBy("workflow").agg(F.bool_or("_many").alias("cyclic"))
    return met.join(cyclic, "workflow").select("workflow", "node", "cyclic", F.when(F.col("cyclic"), 0).otherwise(F.col("level")).alias("level"))


def workflow_terminals(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow, node, role, forced): members that no edge enters are entries, that no edge leaves exits; where every member is entered, the first one is an entry all the same (GRF-9)."""
    m = membership.select("workflow", "node").distinct()
    entered = edges.select(F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(True))
    left = edges.select(F.col("src").alias("node")).distinct().withColumn("_out", F.lit(True))
    met = m.join(entered, "node", "left").join(left, "node", "left")
    free = met.where("_in IS NULL")
    forced = m.join(free.select("workflow").distinct(), "workflow", "left_anti").groupBy("workflow").agg(F.min("node").alias("node"))
    part = lambda df, role, forced: df.select("workflow", "node", F.lit(role).alias("role"), F.lit(forced).alias("forced"))
    return part(free, "entry", False).unionByName(part(forced, "entry", True)).unionByName(part(met.where("_out IS NULL"), "exit", False))
