"""Declarative checks: rules are rows, violations are rows (CON-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cardinality(targets: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """targets (subject, class), values (subject, property, value), rules (class, property, least, most): counts outside the bounds."""
    n = values.groupBy("subject", "property").agg(F.count("*").alias("n"))
    met = targets.join(rules, "class").join(n, ["subject", "property"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.where("n < least OR n > most").select("subject", "property", F.col("n").cast("bigint").alias("n"))


def enumeration(values: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (property, allowed): values outside the allowed set."""
    return values.join(rules, "property").where(~F.array_contains("allowed", F.col("value"))).select("subject", "property", "value")


def numeric_range(values: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (property, low, high): values that are no number or lie outside."""
    x = F.col("value").try_cast("double")
    return values.join(rules, "property").where(x.isNull() | (x < F.col("low")) | (x > F.col("high"))).select("subject", "property", "value")


def summary(*checks: tuple[str, str, DataFrame], strict: bool = False) -> DataFrame:
    """(name, severity, violations, ok) of each (name, severity, violations); warnings fail only when strict (CON-13)."""
    out = None
    for name, severity, df in checks:
        part = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), "violations")
        part = part.withColumn("ok", (F.col("violations") == 0) | F.lit(severity != "error" and not strict))
        out = part if out is None else out.unionByName(part)
    return out


def endpoints(edges: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """classes (node, class), rules (kind, from_class, to_class): edges whose ends are of another class or of none (CON-4)."""
    a, b = (classes.select(F.col("node").alias(end), F.col("class").alias(f"_{end}")) for end in ("src", "dst"))
    met = edges.join(rules, "kind").join(a, "src", "left").join(b, "dst", "left")
    return met.where(~(F.col("_src").eqNullSafe(F.col("from_class")) & F.col("_dst").eqNullSafe(F.col("to_class")))).select("src", "kind", "dst")


def required_when(rows: DataFrame, when: Column, need: Column) -> DataFrame:
    """Rows that meet a condition without what it asks for; unknown counts as not met (CON-6)."""
    return rows.where(F.coalesce(when, F.lit(False)) & ~F.coalesce(need, F.lit(False)))


def degree_bounds(degrees: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (class, least_in, most_in, least_out, most_out), null for no bound: (node, class, n_in, n_out) outside (CON-7)."""
    met = classes.join(rules, "class").join(degrees, "node", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_in", "n_out")})
    out = met.where("n_in < least_in OR n_in > most_in OR n_out < least_out OR n_out > most_out")
    return out.select("node", "class", "n_in", "n_out")


def qualified_counts(nodes: DataFrame) -> DataFrame:
    """nodes (workflow, class): workflows without exactly one Start and at least one End (CON-11)."""
    n = nodes.groupBy("workflow").agg(F.count_if(F.col("class") == "Start").alias("starts"), F.count_if(F.col("class") == "End").alias("ends"))
    return n.where("starts <> 1 OR ends < 1")


def redundant_next(nexts: DataFrame, branches: DataFrame) -> DataFrame:
    """(src, dst) of next edges that a branch of the same node leads to as well (CON-12)."""
    return nexts.select("src", "dst").distinct().join(branches.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


#: What an evaluation may measure.
DIMENSIONS = ("trust", "quality", "cost", "speed", "safety", "robustness", "resource_usage")


def evaluation(nodes: DataFrame, edges: DataFrame, membership: DataFrame, workflows: DataFrame) -> DataFrame:
    """(node, issue) of evaluations (CON-8). nodes (node, class, dimension), edges (src, dst, kind, on), membership (workflow, node), workflows (workflow, type).

    Each needs evidence (measured_by into it), a target (measures out of it), a pass and a fail branch, a known dimension if any, and lives in oracle workflows only.
    """
    evals = nodes.where("class = 'Eval'").select("node", "dimension")
    facts = edges.select(F.col("dst").alias("node"), F.when(F.col("kind") == "measured_by", "no evidence").alias("x")).unionByName(
        edges.select(F.col("src").alias("node"), F.when(F.col("kind") == "measures", "no target").when((F.col("kind") == "default") & F.col("on").isin("pass", "fail"), F.concat(F.lit("no "), F.col("on"), F.lit(" branch"))).alias("x"))
    )
    has = evals.join(facts.where("x IS NOT NULL").groupBy("node").agg(F.collect_set("x").alias("has")), "node", "left")
    wanted = F.array(*map(F.lit, ("no evidence", "no target", "no pass branch", "no fail branch")))
    odd = F.when(F.col("dimension").isNotNull() & ~F.col("dimension").isin(*DIMENSIONS), F.array(F.lit("unknown dimension"))).otherwise(F.array().cast("array<string>"))
    own = has.select("node", F.explode(F.concat(F.array_except(wanted, F.coalesce("has", F.array().cast("array<string>"))), odd)).alias("issue"))
    homes = membership.join(evals.select("node"), "node").join(workflows, "workflow", "left").where("coalesce(type, '') <> 'oracle'")
    return own.unionByName(homes.select("node", F.lit("outside an oracle workflow").alias("issue")).distinct())


def rule_rows(schema: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cardinality, enumeration, datatype, conditional) rule rows of a field schema (class, field, required, kind, allowed, when_field, when_values) (CON-16).

    Required fields get a least count of 1, enums their allowed values, other kinds a datatype; when_field makes a field required where the other has one of when_values.
    """
    most = F.lit(2**31 - 1)
    cards = schema.where("required").select("class", F.col("field").alias("property"), F.lit(1).alias("least"), most.alias("most"))
    enums = schema.where("kind = 'enum' AND size(allowed) > 0").select("class", F.col("field").alias("property"), "allowed")
    kinds = schema.where("kind IN ('string', 'integer', 'decimal', 'boolean', 'timestamp')").select("class", F.col("field").alias("property"), "kind")
    when = schema.where("when_field IS NOT NULL AND when_values IS NOT NULL").select("class", F.col("field").alias("property"), "when_field", "when_values")
    return cards, enums, kinds, when


def fields(nodes: DataFrame, values: DataFrame, schema: DataFrame) -> DataFrame:
    """(node, field, issue) of nodes (node, class) and their values (node, field, value) against a field schema (CON-14, CON-15): required, not allowed, wrong type, and required by another field."""
    cards, enums, kinds, when = map(F.broadcast, rule_rows(schema))
    nodes = nodes.hint("merge")  # nodes and values grow with the input; only the rules are sent to all
    v = values.withColumnRenamed("field", "property")
    n = v.groupBy("node", "property").agg(F.count("value").alias("n"))
    lacking = nodes.join(cards, "class").join(n.hint("merge"), ["node", "property"], "left").where("coalesce(n, 0) < least").select("node", "property", F.lit("required").alias("issue"))
    typed = nodes.join(v, "node")
    odd = typed.join(enums, ["class", "property"]).where(~F.array_contains("allowed", F.col("value"))).select("node", "property", F.lit("not allowed").alias("issue"))
    fits = F.when(F.col("kind") == "integer", F.col("value").try_cast("bigint").isNotNull()).when(F.col("kind") == "decimal", F.col("value").try_cast("double").isNotNull())
    fits = fits.when(F.col("kind") == "boolean", F.lower("value").isin("true", "false")).when(F.col("kind") == "timestamp", F.col("value").try_cast("timestamp").isNotNull()).otherwise(True)
    wrong = typed.join(kinds, ["class", "property"]).where(F.col("value").isNotNull() & ~fits).select("node", "property", F.lit("wrong type").alias("issue"))
    asked = typed.select("node", "class", F.col("property").alias("when_field"), "value").join(when, ["class", "when_field"]).where(F.array_contains("when_values", F.col("value"))).select("node", "property").distinct()
    absent = asked.join(n.where("n > 0").hint("merge"), ["node", "property"], "left_anti").select("node", "property", F.lit("required here").alias("issue"))
    return lacking.unionByName(odd).unionByName(wrong).unionByName(absent).withColumnRenamed("property", "field").distinct()


def range_classes(triples: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """(s, p, o) of predicates with a rule (p, class) whose object is of another class or none; classes (node, class) may have several rows for a node (CON-5)."""
    met = triples.join(rules, "p")
    of = classes.select(F.col("node").alias("o"), "class").distinct()
    return met.join(of, ["o", "class"], "left_anti").select("s", "p", "o").distinct()
