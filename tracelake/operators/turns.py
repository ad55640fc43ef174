"""Turn analytics: transitions, funnels, reprompts and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AS_OF


def recent(as_of: str = AS_OF, days: int = 7, column: str = "timestamp") -> Column:
    """The trailing window; a plain comparison, so it reaches the scan (FLT-1)."""
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def unresolved(turns: DataFrame, **window) -> DataFrame:
    return turns.where(F.col("resolved_intent_id").isNull() & recent(**window))


def pairs(turns: DataFrame, cur: Column, prev: Column | None = None) -> DataFrame:
    """Each turn beside the one before it, successful and resolved on both sides (JOIN-1)."""
    side = turns.where("success AND resolved_intent_id IS NOT NULL")
    now = side.where(cur).select("prev_turn_id", F.col("resolved_intent_id").alias("to_intent"), F.col("resolved_target_concepts").alias("to_concepts"))
    before = (side if prev is None else side.where(prev)).select("turn_id", F.col("resolved_intent_id").alias("from_intent"), F.col("resolved_target_concepts").alias("from_concepts"))
    return now.join(before, now["prev_turn_id"] == before["turn_id"])


def transition_matrix(turns: DataFrame, **window) -> DataFrame:
    """Counts of intent pairs and their share of the source (AGG-1); only the current turn is held to the window."""
    counted = pairs(turns, recent(**window)).groupBy("from_intent", "to_intent").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("from_intent"))
    return counted.withColumn("pct", F.round(F.col("cnt") * F.lit(100.0) / total, 1))


def factored(turns: DataFrame, **window) -> DataFrame:
    """Counts of (intent, concept) pairs (AGG-2); both turns are held to the window, null concepts have a name."""
    named = lambda c: F.coalesce(c, F.lit("_no_concept"))
    p = pairs(turns, recent(**window), recent(**window)).select("from_intent", "to_intent", F.explode("from_concepts").alias("f"), "to_concepts")
    p = p.select("from_intent", named(F.col("f")).alias("from_target_concept"), "to_intent", F.explode("to_concepts").alias("t"))
    return p.groupBy("from_intent", "from_target_concept", "to_intent", named(F.col("t")).alias("to_target_concept")).agg(F.count("*").alias("cnt"))


def funnel(turns: DataFrame, **window) -> DataFrame:
    """Totals, success and effort of each intent (AGG-3)."""
    ok = F.col("success").cast("int")
    return turns.where(recent(**window) & F.col("resolved_intent_id").isNotNull()).groupBy(F.col("resolved_intent_id").alias("intent_id")).agg(
        F.count("*").alias("total"), F.sum(ok).alias("success_count"), F.round(F.avg(ok) * 100, 1).alias("success_rate"),
        F.round(F.avg("reprompt_count"), 2).alias("avg_reprompts"), F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
    )


def reprompt_rate(turns: DataFrame, **window) -> DataFrame:
    """Intents that reprompt at all, by the unrounded mean (AGG-4)."""
    asked = turns.where(recent(**window) & F.col("resolved_intent_id").isNotNull()).groupBy(F.col("resolved_intent_id").alias("intent_id")).agg(
        F.avg("reprompt_count").alias("raw"), F.max("reprompt_count").alias("max_reprompt"), F.sum(F.when(F.col("reprompt_count") > 0, 1).otherwise(0)).alias("some"), F.count("*").alias("n")
    )
    return asked.where("raw > 0").select("intent_id", F.round("raw", 2).alias("avg_reprompt"), "max_reprompt", F.round(F.col("some") * F.lit(100.0) / F.col("n"), 1).alias("pct_reprompted"))


def escalation(turns: DataFrame, *, min_turns: int = 200, min_accuracy: float = 0.85, **window) -> DataFrame:
    return funnel(turns, **window).where((F.col("total") >= min_turns) & (F.col("success_rate") >= min_accuracy * 100))


def suggestions(turns: DataFrame, *, least: float = 40.0, **window) -> DataFrame:
    found = transition_matrix(turns, **window).where(F.col("pct") >= least)
    return found.withColumn("suggestion", F.format_string("%s -> %s", "from_intent", "to_intent"))


def slot_tuning(turns: DataFrame, *, above: float = 1.5, **window) -> DataFrame:
    return reprompt_rate(turns, **window).where(F.col("avg_reprompt") > above)


def keyword_candidates(utterances: DataFrame, *, order: tuple[str, ...] = ("session_id", "turn_id"), least: int = 3, samples: int = 3) -> DataFrame:
    """Words of at least two letters in at least ``least`` utterances, with a few samples (AGG-8).

    Samples are cut per word by a window before they are collected, so a frequent word collects no more than others.
    """
    w = utterances.select(*order, "utterance", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("utterance"), F.lit("[a-z가-힣]+"), F.lit(0)))).alias("word"))
    w = w.where(F.length("word") >= 2)
    counted = w.groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(*[F.col(c).desc() for c in order]))
    few = w.withColumn("r", rank).where(F.col("r") <= samples).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "utterance"))), lambda x: x["utterance"]).alias("samples"))
    return counted.join(few, "word")


def feedback(turns: DataFrame, utterances: DataFrame, **window) -> DataFrame:
    """The four lists of suggestions as one (AGG-9)."""
    parts = [
        suggestions(turns, **window).select(F.lit("matrix").alias("kind"), F.col("suggestion").alias("subject"), F.col("pct").alias("score")),
        slot_tuning(turns, **window).select(F.lit("slots").alias("kind"), F.col("intent_id").alias("subject"), F.col("avg_reprompt").alias("score")),
        keyword_candidates(utterances).select(F.lit("keyword").alias("kind"), F.col("word").alias("subject"), F.col("cnt").cast("double").alias("score")),
        escalation(turns, **window).select(F.lit("escalation").alias("kind"), F.col("intent_id").alias("subject"), F.col("success_rate").alias("score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
