"""Views, orders and listings of a workflow graph (GRF-7, 8, 18..20; TOP-6, 8, 9)."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..tables import stored
from .joins import produced

#: Fixed: the number of rows of a property listing.
LISTED = 140


def repository_trust(trust: DataFrame) -> DataFrame:
    """One row (trust, measured): the mean of what is not null, to four places (GRF-7)."""
    return trust.agg(F.round(F.avg("trust"), 4).alias("trust"), F.count("trust").alias("measured"))


def missing_signals(artifacts: DataFrame) -> DataFrame:
    """(id, signal) of each artifact without confidence or coverage (GRF-7)."""
    missing = F.array_compact(F.array(F.when(F.col("confidence").isNull(), "confidence"), F.when(F.col("coverage").isNull(), "coverage")))
    return artifacts.select("id", F.explode(missing).alias("signal"))


#: With at most so many workflows, those of a node are one array, or bits.
FEW = 256
#: Workflows to a number, a bit each.
BITS = 62


def _sets(pairs: DataFrame) -> DataFrame:
    """(node, of): the workflows of each node of (workflow, node), in an array."""
    return pairs.select("workflow", "node").repartition("node").distinct().groupBy("node").agg(F.collect_list("workflow").alias("of"))


def _once(edges: DataFrame) -> DataFrame:
    """Edges once each, dealt by their start, so that they meet their starts where they are."""
    return edges.select("src", "kind", "dst").repartition("src").distinct()


def _touched(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges with a_src and a_dst, the workflows of their ends, null for none."""
    for end in ("src", "dst"):
        edges = edges.join(sets.select(F.col("node").alias(end), F.col("of").alias(f"a_{end}")).hint("merge"), end, "left")
    return edges


def _rows(touched: DataFrame) -> DataFrame:
    """(workflow, src, kind, dst): an edge is in the workflows of both its ends."""
    none = F.array().cast(touched.schema["a_src"].dataType)
    return touched.select(F.explode(F.array_union(F.coalesce("a_src", none), F.coalesce("a_dst", none))).alias("workflow"), "src", "kind", "dst")


def _few(nodes: DataFrame) -> bool:
    return nodes.select("workflow").distinct().limit(FEW + 1).count() <= FEW


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(workflow, src, kind, dst): the edges that start or end in a workflow's nodes (GRF-8). Edges meet the sets of workflows of their ends, or the workflows one by one where there are many."""
    if _few(nodes):
        return _rows(_touched(_once(edges), _sets(nodes)))
    e = edges.select("src", "kind", "dst").distinct()
    ends = [e.join(nodes.select("workflow", F.col("node").alias(end)), end).select("workflow", "src", "kind", "dst") for end in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()


def _names(nodes: DataFrame) -> list | None:
    """The workflows, null last; None where they are more than FEW."""
    found = [r["workflow"] for r in nodes.select("workflow").distinct().limit(FEW + 1).collect()]
    return sorted(found, key=lambda x: x is None) if len(found) <= FEW else None


def _bits(names: list) -> list[str]:
    return [f"f{j}" for j in range(max(1, -(-len(names) // BITS)))]


def _flags(nodes: DataFrame, names: list) -> DataFrame:
    """(node, f0, f1, ...): the workflows of each node of (workflow, node), a bit each."""
    known = F.array(*[F.lit(x) for x in names if x is not None]).cast(ArrayType(nodes.schema["workflow"].dataType))
    at = F.when(F.col("workflow").isNull(), len(names) - 1).otherwise(F.array_position(known, F.col("workflow")) - 1)
    powers = F.array(*[F.lit(1 << b).cast("long") for b in range(BITS)])
    rows = nodes.where("node IS NOT NULL").select("node", at.cast("int").alias("at"))
    return rows.groupBy("node").agg(*[F.bit_or(F.when(F.floor(F.col("at") / BITS) == j, F.element_at(powers, F.col("at") % BITS + 1)).otherwise(F.lit(0).cast("long"))).alias(f) for j, f in enumerate(_bits(names))])


def _of_bits(names: list, kind: DataType) -> Column:
    """The workflows whose bits are set, as an array of structs."""
    found = [F.when(F.col(f"f{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0, F.struct(F.lit(x).cast(kind).alias("workflow"))) for i, x in enumerate(names)]
    return F.array_compact(F.array(*found, F.lit(None).cast(StructType().add("workflow", kind))))


def _near(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, met, f0, ...): the workflows of a node and its neighbours, and whether an edge with a member touches it. No edge is made distinct for that."""
    f = own.columns[1:]
    parts = [own.select("node", F.lit(False).alias("met"), *f)]
    for here, there in (("src", "dst"), ("dst", "src")):
        met = edges.select("src", "dst").join(own.withColumnRenamed("node", here).hint("merge"), here)
        parts.append(met.select(F.explode(F.array(here, there)).alias("node"), F.lit(True).alias("met"), *f).where("node IS NOT NULL"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("node").agg(F.max("met").alias("met"), *[F.bit_or(c).alias(c) for c in f])


def _flagged(rows: DataFrame, flags: DataFrame, end: str, f: list[str]) -> DataFrame:
    """rows with the bits of one of their ends, none set for a node without; called f0_src, ..."""
    side = flags.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in f])
    return rows.join(side.hint("merge"), end, "left").withColumns({f"{c}_{end}": F.coalesce(f"{c}_{end}", F.lit(0).cast("long")) for c in f})


def stream_view(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """The edges that touch the members or their neighbours (GRF-8, stream view)."""
    own = membership.select("workflow", "node")
    names = _names(own)
    if names is not None:
        flags, f = stored(_near(edges, _flags(own, names))), _bits(names)
        seen = _flagged(_flagged(_once(edges), flags, "src", f), flags, "dst", f)
        seen = seen.withColumns({c: F.col(f"{c}_src").bitwiseOR(F.col(f"{c}_dst")) for c in f})
        return seen.select(F.explode(_of_bits(names, own.schema["workflow"].dataType)).alias("w"), "src", "kind", "dst").select("w.workflow", "src", "kind", "dst")
    near = touching(edges, membership).select("workflow", F.explode(F.array("src", "dst")).alias("node"))
    return touching(edges, own.unionByName(near).distinct())


def stream_counts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(workflow, nodes, edges) of the stream view (GRF-8), as view_counts gives them.

    With few workflows no row of the view is made: an edge goes from its start to its end once, with bits for workflows, and a
    start goes along only where its end may tell it of more. An edge's bits are those of its ends, a node's those of its edges.
    """
    own = membership.select("workflow", "node")
    names = _names(own)
    if names is None:
        return view_counts(stream_view(edges, membership))
    flags, f = stored(_near(edges, _flags(own, names))), _bits(names)
    full = _all(F.col(f"{c}_src") == (1 << min(BITS, len(names) - j * BITS)) - 1 for j, c in enumerate(f))
    sent = _flagged(_once(edges), flags, "src", f).select("dst", F.when(~full, F.col("src")).alias("src"), *[f"{c}_src" for c in f])
    seen = _flagged(sent, flags, "dst", f).withColumns({c: F.col(f"{c}_src").bitwiseOR(F.col(f"{c}_dst")) for c in f})
    # A row without a node is an edge; a node that learns nothing new has its row in flags.
    new = {end: ~_all(F.col(c) == F.col(f"{c}_{end}") for c in f) for end in ("src", "dst")}
    nodes = [F.struct(F.lit(None).cast(flags.schema["node"].dataType).alias("node"))] + [F.when(F.col(end).isNotNull() & new[end], F.struct(F.col(end).alias("node"))) for end in ("src", "dst")]
    rows = seen.where(~_all(F.col(c) == 0 for c in f)).select(F.explode(F.array_compact(F.array(*nodes))).alias("n"), *f).select("n.node", *f)
    rows = rows.unionByName(flags.where("met").select("node", *f))
    by_node = rows.groupBy("node", *[F.when(F.col("node").isNull(), F.col(c)).alias(f"edge_{c}") for c in f]).agg(F.count("*").alias("n"), *[F.bit_or(c).alias(c) for c in f])
    by_bits = by_node.groupBy(*f).agg(F.count("node").alias("nodes"), F.sum(F.when(F.col("node").isNull(), F.col("n")).otherwise(0)).alias("edges"))
    # As in view_counts, edges of a workflow that is null are not counted.
    counts = by_bits.select(F.explode(_of_bits(names, own.schema["workflow"].dataType)).alias("w"), "nodes", "edges").select("w.workflow", "nodes", "edges").groupBy("workflow").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
    return counts.select("workflow", "nodes", F.when(F.col("workflow").isNull(), 0).otherwise(F.col("edges")).cast("long").alias("edges"))


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions)


def control_view(rails: DataFrame, membership: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The rails that touch the members, without those that start or end in an artifact (GRF-8, control view)."""
    view = touching(rails, membership)
    for end in ("src", "dst"):
        view = view.join(artifacts.select(F.col("id").alias(end)).distinct(), end, "left_anti")
    return view.select("workflow", "src", "kind", "dst")


def combined_view(rails: DataFrame, streams: DataFrame, membership: DataFrame) -> DataFrame:
    """The rails that touch the members, artifacts too, and the stream view (GRF-8, combined view). Its counts take the members too."""
    return touching(rails, membership).unionByName(stream_view(streams, membership)).distinct()


def view_counts(view: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(workflow, nodes, edges) of a view (GRF-8). With members (workflow, node), those without an edge count too."""
    ends = view.select("workflow", F.explode(F.array("src", "dst")).alias("node"))
    if members is not None:
        ends = ends.unionByName(members.select("workflow", "node"))
    n = ends.distinct().groupBy("workflow").agg(F.count("*").alias("nodes"))
    e = view.groupBy("workflow").agg(F.count("*").alias("edges"))
    return n.join(e, "workflow", "left").select("workflow", "nodes", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


def target_mismatches(targets: DataFrame, streams: DataFrame, membership: DataFrame) -> DataFrame:
    """targets (workflow, artifact) that the workflow does not produce, with how many artifacts it does (GRF-18)."""
    made = produced(streams, membership)
    n = made.groupBy("workflow").agg(F.count("*").alias("available"))
    return targets.join(made, ["workflow", "artifact"], "left_anti").join(n, "workflow", "left").select("workflow", "artifact", F.coalesce("available", F.lit(0).cast("long")).alias("available"))


def supply_flag(nodes: DataFrame, streams: DataFrame) -> DataFrame:
    """nodes (node, ...) with in_supply: whether any stream touches it (GRF-19)."""
    on = streams.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_on", F.lit(True))
    return nodes.join(on, "node", "left").select(*nodes.columns, F.coalesce("_on", F.lit(False)).alias("in_supply"))


def artifact_index(artifacts: DataFrame) -> DataFrame:
    """(id, provenance): the signals an artifact has, in one line (GRF-20)."""
    return artifacts.select("id", F.concat_ws(" · ", "method", "author", "validation").alias("provenance"))


def chain_order(links: DataFrame) -> DataFrame:
    """links (node, previous), previous null at a head: (node, head, distance) by pointer jumping.

    Every round doubles how far a node sees, so a chain of n takes log2(n) joins. Nodes that no head reaches (cycles, and
    what hangs on a node that is not there) have neither head nor distance (TOP-6).
    """
    at = stored(links.select("node", F.coalesce("previous", "node").alias("head"), F.col("previous").isNotNull().cast("long").alias("distance"), F.col("previous").isNull().alias("done")))
    for _ in range(math.ceil(math.log2(max(at.count(), 2))) + 1):
        if at.where("NOT done").limit(1).count() == 0:
            break
        ahead = at.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("distance").alias("_distance"), F.col("done").alias("_done"))
        step = at.where("NOT done").join(ahead, "head", "left")
        moved = step.select("node", F.coalesce("_head", "head").alias("head"), (F.col("distance") + F.coalesce("_distance", F.lit(0))).alias("distance"), F.coalesce("_done", F.lit(False)).alias("done"))
        at = stored(at.where("done").unionByName(moved))
    return at.select("node", F.when(F.col("done"), F.col("head")).alias("head"), F.when(F.col("done"), F.col("distance")).alias("distance"))


def property_map(edges: DataFrame, *, limit: int = LISTED) -> DataFrame:
    """edges (property, domain, range): the first of the pairs in order (TOP-8)."""
    return edges.select("property", "domain", "range").distinct().orderBy("property", "domain", "range").limit(limit)


def unit_order(units: DataFrame) -> DataFrame:
    """units (id, order): (id, position) sorted by the order, else by the number that leads the id, else last (TOP-9)."""
    number = F.regexp_extract("id", r"^(?:phase[-_])?(\d+)", 1).try_cast("int")
    return units.select("id", F.coalesce(F.col("order").try_cast("int"), number, F.lit(999)).alias("position")).orderBy("position", "id")
