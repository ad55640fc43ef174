"""What a session offers its next turn: the first run named, the entity last referred to, the turn before.

The target of a turn depends on the session only through whether a run and an entity are known: it is one of four values, worked out per row by grounding with markers in their place. So an
entity known before a turn is that of the last turn with a target of its own, else the first that a turn falls back to, and a session is a composition of constant steps that
can be cut anywhere. ``carried`` does so: within a session and a span of time, then over the spans. A task holds one session's turns of one span, or one row for each of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from . import grounding as G

RUN, ENTITY = "\x01run", "\x01entity"
IDLE = "12 hours"
SPAN = "hour"


def carried(rows: DataFrame, keys: list[str], order: list[str], span: Column, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds for each name the first or last non-null value, or the sum, of an expression over the rows of the same keys that come before in the given order.

    ``span`` must not fall along the order; it cuts the rows of hot keys.
    """
    kinds = {"first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum}
    cut = rows.withColumns({"_span": span} | {f"_of_{n}": c for n, (_, c) in values.items()})
    inner = Window.partitionBy(*keys, "_span").orderBy(*order)
    own = cut.withColumns({f"_in_{n}": kinds[k](F.col(f"_of_{n}")).over(inner.rowsBetween(Window.unboundedPreceding, -1)) for n, (k, _) in values.items()})
    place = F.struct(*order)
    whole = {"first": lambda n: F.min_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), place)), "last": lambda n: F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), place)), "sum": lambda n: F.sum(f"_of_{n}")}
    spans = cut.groupBy(*keys, "_span").agg(*[whole[k](n).alias(f"_all_{n}") for n, (k, _) in values.items()])
    outer = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({f"_all_{n}": kinds[k](F.col(f"_all_{n}")).over(outer) for n, (k, _) in values.items()})
    other = spans.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_span"]], *[f"_all_{n}" for n in values])
    met = own.join(other, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_span"]])

    def joined(n: str, kind: str) -> Column:
        before, now = F.col(f"_all_{n}"), F.col(f"_in_{n}")
        if kind == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(now, F.lit(0))
        return F.coalesce(before, now) if kind == "first" else F.coalesce(now, before)

    return met.select(*rows.columns, *[joined(n, k).alias(n) for n, (k, _) in values.items()])


def targets_by_session(utterances: DataFrame, intents: DataFrame) -> DataFrame:
    """Adds said_run, the run that the text names, and targets: the turn's target where the session knows no run and no entity, a run, an entity, both. RUN and ENTITY stand for theirs."""
    met = G.with_intent(utterances.drop("run_ids", "last_referenced_entity"), intents)
    none = F.lit(None).cast("string")
    # One row is grounded with four sessions: fill_slots and resolve_target are expressions over its columns.
    out = met.withColumn("said_run", fn.reference(F.col("norm"), "run"))
    tried = []
    for k, (run, entity) in enumerate([(False, False), (True, False), (False, True), (True, True)]):
        asked = out.withColumns({"run_ids": F.array(F.lit(RUN)) if run else F.array().cast("array<string>"), "last_referenced_entity": F.lit(ENTITY) if entity else none})
        out = G.resolve_target(G.fill_slots(asked)).withColumnRenamed("target_id", f"_t{k}").drop("slots", "missing", "target_concepts", "run_ids", "last_referenced_entity")
        tried.append(f"_t{k}")
    return out.select(*[c for c in utterances.columns if c not in ("run_ids", "last_referenced_entity")], "said_run", F.array(*tried).alias("targets"))


def with_session(utterances: DataFrame, intents: DataFrame, *, idle: str = IDLE, span: str = SPAN) -> DataFrame:
    """Utterances (session_id, turn_id, timestamp, utterance, intent_id) with run_ids, last_referenced_entity and prev_turn_id of their session so far.

    Turns stand in the order of timestamp and turn_id; a turn_id counts once, at its earliest; after a pause of more than ``idle`` a session begins anew. Rows without session, turn or time are left out.
    """
    order, at = ["timestamp", "turn_id"], F.date_trunc(span, "timestamp")
    rows = utterances.where("session_id IS NOT NULL AND turn_id IS NOT NULL AND timestamp IS NOT NULL")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "turn_id").orderBy("timestamp", F.xxhash64("utterance", "intent_id")))).where("_n = 1").drop("_n")
    t = targets_by_session(once, intents)
    t = carried(t, ["session_id"], order, at, {"_ts": ("last", F.col("timestamp")), "prev_turn_id": ("last", F.col("turn_id"))})
    new = F.col("_ts").isNull() | (F.col("timestamp") > F.col("_ts") + F.expr(f"INTERVAL {idle}"))
    t = t.withColumn("_new", new.cast("int")).withColumn("prev_turn_id", F.when(~new, F.col("prev_turn_id")))
    t = carried(t, ["session_id"], order, at, {"_part": ("sum", F.col("_new"))}).withColumn("_part", F.col("_part") + F.col("_new"))
    t = carried(t, ["session_id", "_part"], order, at, {"_run": ("first", F.col("said_run"))})
    known = F.when(F.col("_run").isNull(), 0).otherwise(1)
    real = lambda v: F.when(v == RUN, F.col("_run")).otherwise(v)
    without, beside = real(F.get("targets", known)), F.get("targets", known + 2)
    t = t.withColumns({"_own": F.when(beside != ENTITY, real(beside)), "_else": F.when(beside == ENTITY, without)})
    t = carried(t, ["session_id", "_part"], order, at, {"_last": ("last", F.col("_own")), "_first": ("first", F.col("_else"))})
    return t.select(*once.columns, F.array_compact(F.array("_run")).alias("run_ids"), F.coalesce("_last", "_first").alias("last_referenced_entity"), "prev_turn_id")
