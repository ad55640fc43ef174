"""Rules over paths of a graph of triples (s, p, o), with negation: evaluations, tool delegation, redundant and forbidden edges (CON-9, CON-10, CON-12).

Triples are stored by predicate, as they come: they may repeat, and what is joined is made distinct first, on the key of its join. Rules about one node alone are
decided by one grouping, as bits that say what the node is and has. A rule about pairs says what needs something and what meets that need, both as relations on up to two keys. All
these needs stand in two tables with the rule's number as a further key, those that must be met and those that must not, and so do what meets them: two joins decide them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored

#: Names of cases, and roles of folders that are written to and read from.
FAIL, PASS = ("fail", "failed"), ("pass", "passed")
WRITTEN, READ = ("staging", "generated", "write"), ("staging", "read")
TOOL_PREFIXES = ("tool:", "process:")


def _tool(label: Column) -> Column:
    return F.startswith(label, F.lit("[[")) | reduce(lambda a, b: a | b, [F.startswith(F.lower(label), F.lit(p)) for p in TOOL_PREFIXES])


class Facts:
    """Relations (s, o) of triples. Those that several rules name are worked out once."""

    def __init__(self, triples: DataFrame):
        self.triples = stored(triples.select("s", "p", "o"), partition_by="p")
        self.made: dict[str, DataFrame] = {}

    def of(self, *predicates: str) -> DataFrame:
        """(s, o), which may repeat."""
        return self.triples.where(F.col("p").isin(*predicates)).select("s", "o")

    def once_by(self, key: str, *predicates: str) -> DataFrame:
        """(s, o), each once, dealt by the key that a join on it needs."""
        return self.of(*predicates).repartition(key).distinct()

    def a(self, *classes: str) -> DataFrame:
        """(s): the members of classes, once for each."""
        return self.once("type", lambda: self.of("type").distinct()).where(F.col("o").isin(*classes)).select("s")

    def back(self, *predicates: str) -> DataFrame:
        return self.of(*predicates).select(F.col("o").alias("s"), F.col("s").alias("o"))

    def to(self, relation: DataFrame, *classes: str) -> DataFrame:
        """The pairs that end in a member of the classes."""
        return relation.join(self.a(*classes).withColumnRenamed("s", "o"), "o", "left_semi").select("s", "o")

    def at(self, relation: DataFrame, *classes: str) -> DataFrame:
        return relation.join(self.a(*classes), "s", "left_semi").select("s", "o")

    def then(self, first: DataFrame, second: DataFrame) -> DataFrame:
        """(s, o) over a step in between; each should hold a pair once."""
        return first.select("s", F.col("o").alias("m")).join(second.select(F.col("s").alias("m"), "o"), "m").select("s", "o")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = stored(make())
        return self.made[name]

    def cases(self, *names: str) -> DataFrame:
        """(s, o): nodes and their branches for a case, each once."""
        named = self.of("on").where(F.lower("o").isin(*names)).select(F.col("s").alias("o"))
        return self.once_by("o", "hasBranch").join(named, "o", "left_semi").select("s", "o")

    def folders(self, written: bool) -> DataFrame:
        """(s, path) of the folders that a node writes, or reads: a folder without a role is read."""

        def make() -> DataFrame:
            d = self.once_by("o", "directory").select("s", F.col("o").alias("d")).join(self.once_by("s", "dirPath").select(F.col("s").alias("d"), F.col("o").alias("path")), "d")
            d = d.join(self.once_by("s", "dirRole").select(F.col("s").alias("d"), F.lower("o").alias("role")), "d", "left")
            has = lambda x: F.contains(F.col("role"), F.lit(x))
            writes = F.coalesce(has("output") | F.col("role").isin(*WRITTEN), F.lit(False))
            reads = F.col("role").isNull() | has("input") | has("reference") | has("instruction") | F.col("role").isin(*READ)
            return d.select("s", F.col("path").alias("o"), writes.alias("w"), reads.alias("r"))

        return self.once("folders", make).where("w" if written else "r").select("s", "o")

    def made_in(self) -> DataFrame:
        """(w, o, kind): what tasks and decisions of a workflow make: artifacts, labels of these, deliverables and folders."""

        def make() -> DataFrame:
            by = self.once_by("o", "hasNode").select(F.col("s").alias("w"), F.col("o").alias("s")).join(self.a("Task", "Decision"), "s", "left_semi")
            things = self.once_by("s", "produces").withColumn("kind", F.lit("artifact")).unionByName(
                self.once_by("s", "deliverables").unionByName(self.folders(True)).withColumn("kind", F.lit("label"))
            )
            return by.join(things, "s").select("w", "o", "kind").distinct()

        def with_labels() -> DataFrame:
            own = self.once("made", make)
            artifacts = own.where("kind = 'artifact'").select("w", F.col("o").alias("s")).join(self.a("Artifact"), "s", "left_semi")
            labels = artifacts.join(self.of("label").distinct(), "s").select("w", "o", F.lit("label").alias("kind"))
            return own.unionByName(labels)

        return self.once("made_in", with_labels)

    def delivers(self) -> DataFrame:
        """(s): what has a deliverable or writes a folder."""
        return self.once("delivers", lambda: self.of("deliverables").select("s").unionByName(self.folders(True).select("s")).distinct())


def node_rules(f: Facts) -> DataFrame:
    """(rule, focus) of the rules that what a node is and has decides: one row a node, with a bit for each."""
    classes = ("Eval", "Decision", "Step", "Artifact")
    nodes = f.a("Artifact").withColumnRenamed("s", "o")
    has = {
        "measured": f.of("targetArtifact"), "target": f.of("target"), "next": f.of("next"), "taken": f.back("consumes", "check"), "uses": f.of("usesTool"), "produces": f.of("produces"),
        "ends": f.cases(*PASS).join(f.of("gotoNode").select(F.col("s").alias("o")), "o", "left_anti"),
        "several": f.once_by("s", "hasBranch").where("o IS NOT NULL").groupBy("s").count().where("count >= 2"),
        "fed": f.folders(False).select("s").unionByName(f.back("consumes", "check").join(nodes, "o", "left_semi").select("s")),
        "gives": f.delivers().unionByName(f.to(f.of("produces"), "Artifact").select("s")),
    }
    bits = {name: 1 << i for i, name in enumerate([*classes, *has])}
    kinds = [f.of("type").where(F.col("o").isin(*classes)).select("s", reduce(lambda w, c: w.when(F.col("o") == c, bits[c]), classes, F).alias("bits"))]
    rows = reduce(DataFrame.unionByName, kinds + [df.where("s IS NOT NULL").select("s", F.lit(bits[name]).alias("bits")) for name, df in has.items()])
    is_ = lambda *names: reduce(lambda x, y: x & y, [F.col("bits").bitwiseAND(bits[n]) > 0 for n in names])
    broken = {
        "eval-artifact": is_("Eval") & ~is_("measured"), "eval-target": is_("Eval") & ~is_("target"), "eval-pass-terminal": is_("Eval") & ~is_("ends"), "eval-next": is_("Eval", "next"),
        "eval-consumes": is_("Eval", "taken"), "eval-branches": is_("Eval") & ~is_("several"), "decision-branches": is_("Decision") & ~is_("several"),
        "tool-input": is_("Step", "uses") & ~is_("fed"), "tool-output": is_("Step", "uses") & ~is_("gives"), "artifact-produces": is_("Artifact", "produces"),
    }
    found = F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in broken.items()]))
    return rows.groupBy("s").agg(F.bit_or("bits").alias("bits")).select(F.explode(found).alias("rule"), F.col("s").alias("focus"))


def _need(df: DataFrame, focus: str = "s", *keys: str) -> DataFrame:
    """(focus, k1, k2)."""
    return df.select(F.col(focus).alias("focus"), *[(F.col(keys[i]) if i < len(keys) else F.lit("")).alias(f"k{i + 1}") for i in range(2)])


def pair_rules(f: Facts) -> list[tuple[str, bool, DataFrame, DataFrame]]:
    """(name, whether it must be met or must not, needs (focus, k1, k2), what meets them (k1, k2)). What meets a need may repeat."""
    evals, workflows = f.a("Eval"), f.a("Workflow")
    target = f.once("eval_target", lambda: f.at(f.once_by("s", "target"), "Eval"))
    measured = f.once("eval_label", lambda: f.at(f.once_by("s", "targetArtifact"), "Eval"))
    key = lambda df, *c: df.select(*[(F.col(c[i]) if i < len(c) else F.lit("")).alias(f"k{i + 1}") for i in range(2)])
    goto = f.once_by("s", "gotoNode")
    fail_evolves = f.then(f.then(f.cases(*FAIL), f.to(goto, "Task")).distinct(), f.to(f.once_by("s", "evolves"), "Workflow"))
    evidence = target.select("s", F.col("o").alias("w")).join(f.once_by("o", "measures").select(F.col("o").alias("s"), F.col("s").alias("o")), "s")
    labelled = target.select("s", F.col("o").alias("w")).join(measured.where(~_tool(F.col("o"))), "s")
    tools = measured.where(_tool(F.col("o")))
    using = f.at(f.of("usesTool"), "Step")
    revised = tools.select("s", F.col("o").alias("tool")).join(f.once_by("s", "orderTarget"), "s")
    steps = f.at(f.of("targetArtifact"), "Step").select(F.col("o").alias("tool"), F.regexp_replace("s", "^.*/", "").alias("o")).distinct()
    goes = f.then(f.once_by("o", "hasBranch"), goto)
    return [
        ("eval-target-class", True, _need(target, "s", "o"), key(workflows, "s")),
        ("eval-own-container", False, _need(target, "s", "o", "s"), key(f.of("hasNode"), "s", "o")),
        ("evolves-class", True, _need(f.of("evolves"), "s", "o"), key(workflows, "s")),
        ("eval-fail-evolves", True, _need(target, "s", "s", "o"), key(fail_evolves, "s", "o")),
        ("eval-evidence-producer", True, _need(evidence, "s", "w", "o"), key(f.made_in().where("kind = 'artifact'"), "w", "o")),
        ("eval-label-producer", True, _need(labelled, "s", "w", "o"), key(f.made_in().where("kind = 'label'"), "w", "o")),
        ("decision-redundant-next", False, _need(f.at(f.of("next"), "Decision"), "s", "s", "o"), key(goes, "s", "o")),
        ("eval-tool-producer", True, _need(tools, "s", "o"), key(using.join(f.delivers(), "s", "left_semi"), "o").distinct()),
        ("eval-revision", True, _need(revised, "s", "tool", "o"), key(steps, "tool", "o")),
        ("artifact-measures", True, _need(f.at(f.of("measures"), "Artifact"), "s", "o"), key(evals, "s")),
        ("artifact-consumed-by-eval", False, _need(f.at(f.of("consumes", "check"), "Artifact"), "s", "o"), key(evals, "s")),
        ("stream-terminal", False, _need(f.at(f.of("from", "to"), "Stream"), "s", "o"), key(f.a("Start", "End"), "s")),
    ]


def violations(triples: DataFrame) -> DataFrame:
    """(rule, focus) of what breaks a rule."""
    f = Facts(triples)
    found = pair_rules(f)
    names = F.array(*[F.lit(name) for name, *_ in found])

    def judged(must: bool) -> DataFrame:
        of = [(i, needs, meets) for i, (_, m, needs, meets) in enumerate(found) if m == must]
        needs, meets = (reduce(DataFrame.unionByName, [r[side].withColumn("rule", F.lit(r[0])) for r in of]) for side in (1, 2))
        return needs.join(meets, ["rule", "k1", "k2"], "left_anti" if must else "left_semi").select("rule", "focus")

    pairs = judged(True).unionByName(judged(False)).distinct()
    return pairs.select(F.get(names, F.col("rule")).alias("rule"), "focus").unionByName(node_rules(f))
