"""Runtime logs: counters, failure hotspots and repeated signals over raw JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that mark a failure.
FAILURE = "fail|failed|error|blocked|timeout|exception"
#: Where a value may stand, first match wins.
PATHS = {
    "status": ["status", "result.status", "metadata.status"],
    "event": ["event_type", "type", "entry_type", "kind"],
    "workflow": ["workflow", "workflow_id", "metadata.workflow", "metadata.workflow_id"],
    "phase": ["phase", "phase_id", "metadata.phase", "metadata.phase_id"],
    "node": ["node", "node_id", "metadata.node", "metadata.node_id"],
    "tool": ["tool", "tool_name", "tool.name", "metadata.tool", "command"],
    "intent": ["intent_id", "intent.id", "metadata.intent_id"],
    "id": ["id", "entry_id", "metadata.id", "run_id", "ticket_id", "intent_id"],
    "error": ["error", "exception", "failure", "metadata.severity"],
}
HOTSPOTS = ("workflow", "phase", "node", "tool", "intent")


def first_of_paths(value: Column, paths: list[str]) -> Column:
    """The first path with a value that is not empty (FLT-6)."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{p}", "string"), F.lit("")) for p in paths])


def failure_like(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields)).rlike(FAILURE)


def parsed(lines: DataFrame) -> DataFrame:
    """(scope, line, one column for each of PATHS) of the lines that are JSON objects; one pass, no shuffle."""
    v = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return v.select("scope", "line", *[first_of_paths(F.col("v"), p).alias(n) for n, p in PATHS.items()])


def counters(lines: DataFrame, dims: tuple[str, ...] = ("status", "event", "workflow", "intent")) -> DataFrame:
    """Counts by scope, dimension and value; all dimensions share one shuffle (AGG-10)."""
    spread = parsed(lines).select("scope", F.explode_outer(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("x"))
    return spread.where("x.value IS NOT NULL").groupBy("scope", "x.dim", "x.value").agg(F.count("*").alias("cnt"))


def hotspots(lines: DataFrame) -> DataFrame:
    """Failing records by dimension; those without any count as unknown in their scope (AGG-11)."""
    bad = parsed(lines).where(failure_like(F.col("status"), F.col("event"), F.col("error")))
    dims = F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{d}:"), d)) for d in HOTSPOTS]))
    some = F.when(F.size(dims) == 0, F.array(F.concat("scope", F.lit(":unknown")))).otherwise(dims)
    return bad.select(F.explode_outer(some).alias("hotspot")).groupBy("hotspot").agg(F.count("*").alias("cnt"))


def repeated(lines: DataFrame) -> DataFrame:
    """(scope, id, cnt) of ids that occur more than once, the most frequent first (AGG-12)."""
    return parsed(lines).where("id IS NOT NULL").groupBy("scope", "id").agg(F.count("*").alias("cnt")).where("cnt > 1").orderBy(F.col("cnt").desc(), "scope", "id")


def prefixes(lines: DataFrame) -> DataFrame:
    """(prefix, cnt): ids by their two capital letters before a dash or underscore (AGG-10)."""
    p = parsed(lines).select(F.regexp_extract("id", "^([A-Z]{2})[-_]", 1).alias("prefix"))
    return p.where("prefix <> ''").groupBy("prefix").agg(F.count("*").alias("cnt"))


def scope_counts(lines: DataFrame) -> DataFrame:
    """(scope, records, bad) by scope: lines with text, and how many of them are no JSON object (SRC-6, AGG-10)."""
    bad = F.coalesce(~F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(True))
    return lines.where(F.trim("value") != "").groupBy("scope").agg(F.count("*").alias("records"), F.count_if(bad).alias("bad"))


def normalized(value: Column) -> Column:
    """A JSON value as a short text: the first three of an array, an object cut at 120, a scalar trimmed; null for what is empty (FLT-7).

    ``value`` is a VARIANT. Spark keeps an object's keys sorted.
    """
    kind = F.schema_of_variant(value)
    items = F.transform(F.slice(F.try_variant_get(value, "$", "array<string>"), 1, 3), lambda x: F.coalesce(x, F.lit("None")))
    text = F.when(kind.startswith("ARRAY"), F.array_join(items, ", ")).when(kind.startswith("OBJECT"), F.substring(F.to_json(value), 1, 120))
    return text.when(kind != "VOID", F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit("")))


def top(df: DataFrame, count: str, *keys: str, k: int = 10) -> DataFrame:
    """The k largest counts; equal ones by key (TOP-1)."""
    return df.orderBy(F.col(count).desc(), *keys).limit(k)
