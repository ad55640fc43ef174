"""Node and edge tables: evidence, trust, views, degrees, reachability, loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, stored

def evidence(streams: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(src, dst, via): what was consumed is evidence of what the same run produced (GRF-1, JOIN-4, JOIN-5, SET-2).

    One row per pair with the least run that shows it; no self pairs; pairs given explicitly are left out.
    """
    eaten = streams.where("kind = 'consumed_by'").select(F.col("src").alias("a"), F.col("dst").alias("run"))
    made = streams.where("kind = 'produces_to'").select(F.col("src").alias("run"), F.col("dst").alias("b"))
    found = eaten.join(made, "run").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("run").alias("via"))
    return found if explicit is None else found.join(explicit.select("src", "dst"), ["src", "dst"], "left_anti")


#: What counts as declared provenance.
PROVENANCE = ("author", "version", "timestamp", "validation", "coverage", "confidence")


def own_trust(artifacts: DataFrame) -> DataFrame:
    """(id, trust): 0.4 confidence, 0.2 validated, 0.2 coverage, 0.2 declared provenance (GRF-2)."""
    clamp = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double"))), F.lit(0.5))
    declared = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in PROVENANCE), F.lit(0))
    t = 0.4 * clamp(F.col("confidence")) + F.when(F.col("validation").isNotNull(), 0.2).otherwise(0.0) + 0.2 * clamp(F.col("coverage")) + 0.2 * declared / 6
    return artifacts.select("id", t.alias("trust"))


def propagate(trust: DataFrame, edges: DataFrame, *, rounds: int = 3, own: float = 0.7) -> DataFrame:
    """Synchronous rounds of own * t0 + (1 - own) * mean of the sources' trust (GRF-3). Multi-edges count."""
    base = trust.select("id", F.col("trust").alias("t0"))
    now = trust.select("id", "trust")
    edges = stored(edges.select("src", "dst"))  # every round reads them
    for _ in range(rounds):
        mean = edges.join(now, edges["src"] == now["id"]).groupBy("dst").agg(F.avg("trust").alias("m"))
        now = stored(base.join(mean, base["id"] == mean["dst"], "left").select("id", F.when(F.col("m").isNull(), F.col("t0")).otherwise(own * F.col("t0") + (1 - own) * F.col("m")).alias("trust")))
    return now


#: The score of each executing subject (0.5 if not named).
SUBJECTS = {"human": 0.95, "system": 0.85, "self": 0.75, "workflow": 0.70, "model": 0.65}


def execution_trust(executions: DataFrame) -> DataFrame:
    """(node, trust) of executions (node, subject, method, policy, timestamp): 0.6 subject score, 0.4 declared metadata (GRF-4)."""
    subject = F.coalesce(F.create_map(*[F.lit(x) for pair in SUBJECTS.items() for x in pair])[F.col("subject")], F.lit(0.5))
    declared = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("method", "policy", "timestamp")), F.lit(0))
    return executions.select("node", (0.6 * subject + 0.4 * declared / 3).alias("trust"))


def workflow_trust(streams: DataFrame, membership: DataFrame, trust: DataFrame, executions: DataFrame | None = None, *, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(workflow, trust) of every workflow: weighted means over the edges that it consumes, its executions (node, trust; once a
    member) and the edges that it produces, weights renormalised over the parts there are; null if there is none (GRF-5)."""
    def mean(kind: str, node: str, art: str, name: str) -> DataFrame:
        e = streams.where(F.col("kind") == kind).select(F.col(node).alias("node"), F.col(art).alias("id"))
        return e.join(members, "node").join(trust, "id").groupBy("workflow").agg(F.avg("trust").alias(name))

    members = membership.select("workflow", "node").distinct()
    parts = members.select("workflow").distinct().join(mean("consumed_by", "dst", "src", "c"), "workflow", "left").join(mean("produces_to", "src", "dst", "p"), "workflow", "left")
    if executions is None:
        parts = parts.withColumn("e", F.lit(None).cast("double"))
    else:
        parts = parts.join(members.join(executions.select("node", "trust"), "node").groupBy("workflow").agg(F.avg("trust").alias("e")), "workflow", "left")
    w = [F.when(F.col(n).isNotNull(), x).otherwise(0.0) for n, x in zip("cep", weights, strict=True)]
    top = sum((F.coalesce(F.col(n), F.lit(0.0)) * x for n, x in zip("cep", w, strict=True)), F.lit(0.0))
    return parts.select("workflow", F.when(w[0] + w[1] + w[2] > 0, top / (w[0] + w[1] + w[2])).alias("trust"))


def decisions(measures: DataFrame, workflow_trust: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """(node, workflow, trust, decision) of each measuring edge (node, workflow): pass, fail, or insufficient-signal without a trust (GRF-6)."""
    met = measures.select("node", "workflow").join(workflow_trust.select("workflow", "trust"), "workflow", "left")
    verdict = F.when(F.col("trust").isNull(), "insufficient-signal").when(F.col("trust") >= threshold, "pass").otherwise("fail")
    return met.select("node", "workflow", "trust", verdict.alias("decision"))


def supply(streams: DataFrame, membership: DataFrame) -> DataFrame:
    """(workflow, artifact, producers, consumers): counts of distinct runs (AGG-15)."""
    made = streams.where("kind = 'produces_to'").select(F.col("src").alias("node"), F.col("dst").alias("artifact"), F.lit(1).alias("p"))
    eaten = streams.where("kind = 'consumed_by'").select(F.col("dst").alias("node"), F.col("src").alias("artifact"), F.lit(0).alias("p"))
    once = made.unionByName(eaten).distinct().join(membership, "node")
    return once.groupBy("workflow", "artifact").agg(F.sum("p").alias("producers"), F.sum(1 - F.col("p")).alias("consumers"))


def gaps(streams: DataFrame, membership: DataFrame) -> DataFrame:
    """Produced but not consumed, and consumed but not produced, in a workflow (AGG-16, SET-3)."""
    s = supply(streams, membership)
    return s.where("producers = 0 OR consumers = 0").select("workflow", "artifact", F.when(F.col("consumers") == 0, "unconsumed").otherwise("external").alias("gap"))


#: Types of artifacts that machines keep.
NATIVE = ("knowledge_store", "event_store", "local_database", "table")


def shared_artifacts(uses: DataFrame, *, native: tuple[str, ...] = NATIVE) -> DataFrame:
    """(unit, artifact, produces, consumes) of uses (unit, scope, artifact, type, produces, consumes): artifacts of more than one
    scope or of a machine-native type; deliverables are left out (AGG-17)."""
    kept = uses.where("NOT startswith(artifact, 'deliverable:')")
    shown = kept.groupBy("artifact").agg(F.count_distinct("scope").alias("scopes"), F.bool_or(F.coalesce(F.col("type").isin(*native), F.lit(False))).alias("native")).where("scopes > 1 OR native")
    return kept.join(shown.select("artifact"), "artifact").groupBy("unit", "artifact").agg(F.bool_or("produces").alias("produces"), F.bool_or("consumes").alias("consumes"))


def index(streams: DataFrame, membership: DataFrame) -> DataFrame:
    """Runs and distinct artifacts of each workflow (AGG-18)."""
    s = supply(streams, membership).groupBy("workflow").agg(F.count("*").alias("artifacts"))
    return membership.groupBy("workflow").agg(F.countDistinct("node").alias("nodes")).join(s, "workflow", "left").select("workflow", "nodes", F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


def terminals(edges: DataFrame) -> DataFrame:
    """(node, role): nodes without incoming edges are entries, without outgoing exits (GRF-9)."""
    src, dst = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
    return src.join(dst, "node", "left_anti").withColumn("role", F.lit("entry")).unionByName(dst.join(src, "node", "left_anti").withColumn("role", F.lit("exit")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) by one grouping; the rules on degrees read it (CON-7, GRF-10)."""
    spread = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i")))).alias("x"))
    return spread.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum(1 - F.col("x.i")).alias("n_out"))


def multi_outgoing(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("targets")).where("targets >= 2")


def shared_nodes(membership: DataFrame) -> DataFrame:
    """Nodes with more than one owner (GRF-11)."""
    return membership.groupBy("node").agg(F.count_distinct("workflow").alias("owners")).where("owners > 1")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs with a path of at least one step; semi-naive rounds until nothing is new (GRF-12)."""
    step = stored(edges.select("src", "dst").distinct())
    seen, new = step, step
    while True:
        hop = new.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = stored(hop.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = stored(seen.unionByName(new))


def strong_sets(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles by their strongly connected set, named by its least node.

    Nodes that no cycle passes are trimmed off by degree. Then every node takes the least node that reaches it as its colour; the nodes of a colour that lead back to
    its least node are one set, which is taken out, and the rest goes round again. What is stored grows with the edges, never with the pairs of nodes.
    """
    left, out = stored(edges.select("src", "dst").distinct()), None
    while True:
        while True:
            fed, fed_by = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            kept = stored(left.join(fed, "src", "left_semi").join(fed_by, "dst", "left_semi").select("src", "dst"))
            done = kept.count() == left.count()
            discard(left)
            left = kept
            if done:
                break
        if left.isEmpty():
            none = left.select(F.col("src").alias("node"), F.col("src").alias("component"))
            return out if out is not None else none
        colour = stored(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            least = left.join(colour, left["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
            new = stored(colour.join(least, colour["node"] == least["dst"], "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            discard(colour)
            colour = new
            if colour.where("moved").isEmpty():
                break
        by = colour.select("node", "c")
        inside = left.join(by.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(by.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        inside = stored(inside.select("src", "dst"))
        found = stored(by.where("node = c").select("node"))
        front = found
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            front = stored(back.join(found, "node", "left_anti"))
            found = stored(found.unionByName(front))
        sets = stored(found.join(by, "node").select("node", F.col("c").alias("component")))
        lone = sets.groupBy("component").agg(F.count("*").alias("n"), F.first("node").alias("src")).where("n = 1").join(left.where("src = dst").select("src").distinct(), "src", "left_anti").select("component")
        cyclic = stored(sets.join(lone, "component", "left_anti").select("node", "component"))
        out = cyclic if out is None else out.unionByName(cyclic)
        taken = sets.select("node")
        rest = stored(left.join(taken.withColumnRenamed("node", "src"), "src", "left_anti").join(taken.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        discard(left, inside, colour)
        left = rest


def loops(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """(node, component): nodes on a cycle of a strongly connected set without a gate (GRF-15)."""
    component = strong_sets(edges)
    gated = component.join(gates, "node").select("component").distinct()
    return component.join(gated, "component", "left_anti").select("node", "component")


def uncontrolled(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """(node, component): nodes on a cycle that passes no gate, gates taken out before cycles are looked for (GRF-14)."""
    g = stored(gates.select("node").distinct())
    free = edges.select("src", "dst")
    for end in ("src", "dst"):
        free = free.join(g.withColumnRenamed("node", end), end, "left_anti")
    return loops(free.select("src", "dst"), g.limit(0))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): nodes of an acyclic part peeled by in-degree 0; nodes on or behind a cycle have none (TOP-7)."""
    left = stored(edges.select("src", "dst").distinct())
    nodes = stored(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    out, level = None, 0
    while True:
        free = stored(nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            return out if out is not None else free
        out = free if out is None else out.unionByName(free)
        nodes = stored(nodes.join(free, "node", "left_anti"))
        left = stored(left.join(free.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
        level += 1


def successors(nodes: DataFrame, *, by: str, order: tuple[str, ...], node: str = "node") -> DataFrame:
    """(src, dst): each node's next in document order (TOP-5)."""
    nxt = F.lead(node).over(Window.partitionBy(by).orderBy(*order))
    return nodes.select(F.col(node).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


def uncovered(artifacts: DataFrame) -> DataFrame:
    """Artifacts without any provenance (GRF-16)."""
    return artifacts.where(F.coalesce(*[F.col(c).cast("string") for c in PROVENANCE]).isNull()).select("id")


def without_method(executions: DataFrame) -> DataFrame:
    """Executions that declare no method (GRF-16)."""
    return executions.where("method IS NULL").select("node")


def shapeless(directories: DataFrame) -> DataFrame:
    """(id, missing): directories without a path or a role (GRF-17)."""
    empty = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c))
    return directories.select("id", F.explode(F.array_compact(F.array(empty("path"), empty("role")))).alias("missing"))


def nodes_of(triples: DataFrame) -> DataFrame:
    """(node, types): typed subjects that are no edges, and all their types, sorted (SRC-9, FLT-9)."""
    typed = triples.where("p = 'type'").groupBy(F.col("s").alias("node")).agg(F.array_sort(F.collect_set("o")).alias("types"))
    return typed.where(~F.arrays_overlap("types", F.array(*map(F.lit, EDGE_CLASSES))))


#: The classes of reified edges.
EDGE_CLASSES = ("Rail", "Stream")


def edges_of(triples: DataFrame) -> DataFrame:
    """(edge, class, src, dst, kind, on, criteria, derived): reified edges both of whose ends are nodes (SRC-9). Of several values of one property the least counts (FLT-11)."""
    value = lambda *names: F.min(F.when(F.col("p").isin(*names), F.col("o")))
    used = ("type", "from", "to", "railType", "streamType", "on", "criteria", "derived")
    found = triples.where(F.col("p").isin(*used)).groupBy(F.col("s").alias("edge")).agg(
        F.min(F.when((F.col("p") == "type") & F.col("o").isin(*EDGE_CLASSES), F.col("o"))).alias("class"), value("from").alias("src"), value("to").alias("dst"),
        value("railType", "streamType").alias("kind"), value("on").alias("on"), value("criteria").alias("criteria"), value("derived").alias("derived"),
    ).where("class IS NOT NULL")
    nodes = triples.where("p = 'type'").groupBy(F.col("s").alias("node")).agg(F.bool_or(F.coalesce(F.col("o").isin(*EDGE_CLASSES), F.lit(False))).alias("edge_class")).where("NOT edge_class").select("node")
    for end in ("src", "dst"):
        found = found.join(nodes, found[end] == nodes["node"], "left_semi")
    return found


def of_classes(nodes: DataFrame, *classes: str) -> DataFrame:
    """Nodes of any of the classes, by name (FLT-9, SET-5)."""
    return nodes.where(F.arrays_overlap("types", F.array(*map(F.lit, classes)))).orderBy("node")


def scope_of(node: Column) -> Column:
    """The segment after workflow/, phase/ or node/ where another one follows, else null (FLT-10)."""
    return F.nullif(F.regexp_extract(node, r"(?:^|#)(?:workflow|phase|node)/([^/]+)/[^/]+", 1), F.lit(""))


def display_id(node: Column) -> Column:
    """The last segment (FLT-10, FN-17)."""
    return F.element_at(F.split(node, "[/#]"), -1)


def label_of(triples: DataFrame, predicates: tuple[str, ...] = ("label", "prefLabel", "title")) -> DataFrame:
    """(node, label): the first label there is in the order of the predicates, on one line, else the last segment of the id (FN-17)."""
    first = F.coalesce(*[F.min(F.when(F.col("p") == p, F.nullif(F.trim(F.regexp_replace("o", r"\n", " ")), F.lit("")))) for p in predicates])
    return triples.groupBy(F.col("s").alias("node")).agg(F.coalesce(first, display_id(F.first("s"))).alias("label"))


def legacy_refs(triples: DataFrame) -> DataFrame:
    """(ref): documents that ref literals point at, distinct and sorted (FLT-12)."""
    ref = F.substring_index(F.trim("o"), "#", 1)
    return triples.where("p = 'ref'").select(ref.alias("ref")).where(F.col("ref").rlike(r"\.ya?ml$")).distinct().orderBy("ref")


def subject_of(subject: Column) -> Column:
    """Who executes: ``self`` where none or an unknown one is given (FN-13)."""
    return F.coalesce(F.when(subject.isin(*SUBJECTS), subject), F.lit("self"))


#: Edges of the base and of the oracle layer, and those that hand work over.
BASE_RAILS, ORACLE_RAILS, HAND_OFFS = ("default", "reads", "delegates_to", "escalates_to"), ("measured_by", "measures", "evolves_to", "tests_to"), ("delegates_to", "escalates_to")


def rail_layer(kind: Column) -> Column:
    """oracle, base or unknown (FN-13)."""
    return F.when(kind.isin(*ORACLE_RAILS), "oracle").when(kind.isin(*BASE_RAILS), "base").otherwise("unknown")


def is_hand_off(kind: Column) -> Column:
    return F.coalesce(kind.isin(*HAND_OFFS), F.lit(False))


#: Who decides under each code of a judge.
JUDGES = {"HITL": "human", "HITLFE": "human", "HOTL": "self", "HOOTL": "self", "METRIC": "system"}


def judge_subject(judge: Column) -> Column:
    """The subject for a judge's code, null for other codes (FN-14)."""
    return F.create_map(*[F.lit(x) for pair in JUDGES.items() for x in pair])[F.upper(F.trim(judge))]


#: Older names of subjects.
LEGACY_SUBJECTS = {"user": "human", "agent": "self", "metric": "system"}


def legacy_subject(subject: Column) -> Column:
    """An older subject by its present name; others stay (FN-14)."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LEGACY_SUBJECTS.items() for x in pair])[subject], subject)


def owner_produced(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(workflow, artifact): what members of a workflow, or those that they delegate to, produce (JOIN-11)."""
    members = membership.select("workflow", "node")
    handed = members.join(edges.where("kind = 'delegates_to'").select(F.col("src").alias("node"), "dst"), "node").select("workflow", F.col("dst").alias("node"))
    made = edges.where("kind = 'produces_to'").select(F.col("src").alias("node"), F.col("dst").alias("artifact"))
    return members.unionByName(handed).distinct().join(made, "node").select("workflow", "artifact").distinct()


def improvement_issues(edges: DataFrame, membership: DataFrame, artifacts: DataFrame, sub_workflows: DataFrame) -> DataFrame:
    """(node, kind, target, workflow, issue) of evolves_to and tests_to edges, by the workflow that owns the node (GRF-12, GRF-13).

    An artifact (node) as target must not be produced by the owner (self-produced) and should be consumed or read somewhere (unconsumed, a warning); a workflow as target must
    not be the owner, nor above or below it (not disjoint). sub_workflows (src, dst): parent and child.
    """
    aimed = edges.where("kind IN ('evolves_to', 'tests_to')").select(F.col("src").alias("node"), "kind", F.col("dst").alias("target")).distinct().join(membership.select("workflow", "node").distinct(), "node")
    marked = aimed.join(artifacts.select(F.col("node").alias("target"), F.lit(True).alias("is_artifact")).distinct(), "target", "left")
    at = marked.where("is_artifact").drop("is_artifact")
    own = at.join(owner_produced(edges, membership).withColumnRenamed("artifact", "target"), ["workflow", "target"], "left_semi").withColumn("issue", F.lit("self-produced"))
    used = edges.where("kind IN ('consumed_by', 'reads')").select(F.col("src").alias("target")).distinct()
    idle = at.join(used, "target", "left_anti").withColumn("issue", F.lit("unconsumed"))
    below = closure(sub_workflows)
    kin = below.unionByName(below.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumnsRenamed({"src": "workflow", "dst": "target"})
    others = marked.where("is_artifact IS NULL").drop("is_artifact")
    near = others.where("workflow = target").unionByName(others.where("workflow <> target").join(kin, ["workflow", "target"], "left_semi").select(others.columns)).withColumn("issue", F.lit("not disjoint"))
    columns = ["node", "kind", "target", "workflow", "issue"]
    return own.select(columns).unionByName(idle.select(columns)).unionByName(near.select(columns))


def class_edges(triples: DataFrame) -> DataFrame:
    """(parent, child) of classes (GRF-21)."""
    classes = triples.where("p = 'type' AND o = 'Class'").select("s").distinct()
    return triples.where("p = 'subClassOf'").join(classes, "s", "left_semi").select(F.col("o").alias("parent"), F.col("s").alias("child")).distinct()


#: Types of artifacts, who mainly consumes them, and whether they are data or files.
CONSUMERS = {
    "knowledge_store": ("Agent", "data"),
    "event_store": ("Agent", "data"),
    "local_database": ("Agent", "data"),
    "document": ("Human + Agent", "file"),
    "media": ("Human", "file"),
    "tool": ("Agent + Eval", "file"),
    "table": ("Tool + Agent", "data"),
}


def with_explicit_type(artifacts: DataFrame) -> DataFrame:
    """artifacts (artifact_type, resource_kind, primary_consumer, explicit_type): a valid explicit type overrides all three (FN-8)."""
    known = F.col("explicit_type").isin(*CONSUMERS)
    of = F.create_map(*[x for t, pair in CONSUMERS.items() for x in (F.lit(t), F.struct(F.lit(pair[0]).alias("who"), F.lit(pair[1]).alias("kind")))])[F.col("explicit_type")]
    return artifacts.withColumns({
        "artifact_type": F.when(known, F.col("explicit_type")).otherwise(F.col("artifact_type")), "resource_kind": F.when(known, of["kind"]).otherwise(F.col("resource_kind")),
        "primary_consumer": F.when(known, of["who"]).otherwise(F.col("primary_consumer")),
    })
